"""What several operators share: shared-folder tables, words, tokenizer files, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.shared import shared_dir, stored

#: The white space that separates words, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; for small frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, needs: list[str], new: Iterable[str] = (), keep: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """df with the columns `needs`, and the others under names of this function's own (_c0, _c1 ...); and the columns
    that bring back df's own ones, all or `keep`, under their names, less those that the result replaces (`new`).

    Spark's names ignore case, so all comparisons here do, but a column spelt exactly as needed goes before one that
    differs in case. What works on the frame in between may use any names that don't begin with _c and a digit.
    """
    place = {n: df.columns.index(n) if n in df.columns else [c.lower() for c in df.columns].index(n.lower()) for n in needs}
    there = {i: n for n, i in place.items()}
    replaced = {n.lower() for n in new}
    kept = [i for i, n in enumerate(df.columns) if n.lower() not in replaced and (keep is None or n in keep)]
    flat = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    flat = flat.select(*(F.col(f"_c{i}").alias(n) for n, i in place.items()), *(f"_c{i}" for i in kept if i not in there))
    return flat, [F.col(there.get(i, f"_c{i}")).alias(df.columns[i]) for i in kept]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; asked for on the worker that opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def release() -> None:
    """Gives memory that a worker no longer needs back to the system: it lives on after its task, and its executor's other workers share one limit."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: For operators that run many executions: their shuffle files go when an execution ends, not when the driver happens to
#: collect garbage, and the descriptions of their plans, which the driver keeps, are short.
_MANY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.ui.explainMode": "simple", "spark.sql.maxPlanStringLength": "20000"}


@contextmanager
def many_executions(spark: SparkSession) -> Iterator[None]:
    """Settings for operators that run many executions and keep what they need as tables; they hold while it lasts."""
    before = {key: spark.conf.get(key, None) for key in _MANY}
    for key, value in _MANY.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of characters other than SPACE."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sized_join(big: DataFrame, ids: DataFrame, key: str, how: str, most: int = 1_000_000) -> DataFrame:
    """Joins on key; ids (one narrow row a key) is broadcast if counted at most `most` rows, else both sides shuffle."""
    return big.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (u, v long): component is the smallest id reachable.

    Repeated edges and edges from an id to itself change nothing, edges with a null end are ignored, and no edges give
    no rows.

    Labels spread along edges and then jump to their own label's label, so rounds grow with the logarithm of a
    component's width. Each round is written to the shared folder; nothing but one count reaches the driver.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = cut(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        heard = both.join(label, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("heard"))
        near = label.join(heard, F.col("id") == F.col("u"), "left").select("id", "component", F.least("component", F.coalesce("heard", "component")).alias("next"))
        up = label.select(F.col("id").alias("at"), F.col("component").alias("above"))
        new = cut(near.join(up, F.col("next") == F.col("at"), "left").select("id", F.least("next", F.coalesce("above", "next")).alias("component"), F.col("component").alias("was")))
        changed = new.where("component <> was").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label
