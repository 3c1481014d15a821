"""The session that the engine expects: UTC, adaptive plans, shuffle partitions for the cores at hand."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    build = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        build = build.master(master)
    if partitions:
        build = build.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        build = build.config(k.replace("__", "."), v)
    return build.getOrCreate()
