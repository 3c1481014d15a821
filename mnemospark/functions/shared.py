"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, but only if driver and executors are one process.

    On a cluster executors can't read the driver's local folders, so an unset setting is an error there.
    """
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(at)
        return at
    if at := sc.getCheckpointDir():
        return at
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemospark-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, removed when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions: for rows that are few bytes but much work, which adaptive plans would merge into a few long tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sized(df: DataFrame, rows: int, *keys: str, most: int = 1_000_000) -> DataFrame:
    """df, whose rows were counted, dealt by keys so that a task has about `most` of them; unchanged if it has no more in all.

    What a task sorts or holds then doesn't grow with the data, and adaptive plans don't merge tasks whose rows compress well."""
    return df if rows <= most else df.repartition(max(-(-rows // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session may have ended first; the folder is then the cluster's to clean
        return
