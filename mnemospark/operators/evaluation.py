"""Judged answers to metric tables: accuracy, support within k, rank score, handling; failures and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.columns import rank_support

#: The kinds of conflict that are reported, each always with a row.
KINDS = ("dynamic_conflict", "static_conflict", "conditional_conflict")


def metrics(judged: DataFrame, ks: list[int]) -> DataFrame:
    """For each k and kind: n, AA, SEH, SRS and CH (null for conditional ones, whose answers show it).

    judged: conflict_type, accuracy, support_rank (0: none), handling. Kinds without rows have n 0 and nulls; others
    are left out. The rows meet one row for each k, a list given by the caller.
    """
    spark: SparkSession = judged.sparkSession
    kinds = spark.createDataFrame([(c, k) for c in KINDS for k in ks], "conflict_type string, k int")
    at = judged.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.col("support_rank").between(1, F.col("k")).cast("double")
    found = at.groupBy("conflict_type", "k").agg(
        F.count("*").alias("n"), F.avg("accuracy").alias("aa"), F.avg(hit).alias("seh"),
        F.avg(rank_support(F.col("support_rank"), F.col("k"))).alias("srs"), F.avg(F.col("handling").cast("double")).alias("ch"),
    )
    out = kinds.join(found, ["conflict_type", "k"], "left")
    return out.select("conflict_type", "k", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "aa", "seh", "srs", F.when(F.col("conflict_type") != KINDS[2], F.col("ch")).alias("ch"))


def macro(table: DataFrame) -> DataFrame:
    """Means over the kinds that have a value, for each k."""
    return table.groupBy("k").agg(*(F.avg(c).alias(c) for c in ("aa", "seh", "srs", "ch")))


def failures(judged: DataFrame, by: str, k: int = 3) -> DataFrame:
    """Failed answers (accuracy under 1) by cause: no support in the window, support but a wrong answer, no rank known."""
    failed = F.col("accuracy") < 1
    none = failed & F.col("support_rank").isNull()
    seen = failed & F.col("support_rank").between(1, k)
    lost = failed & F.col("support_rank").isNotNull() & ~F.col("support_rank").between(1, k)
    out = judged.groupBy(by).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.count_if(lost).alias("retrieval"), F.count_if(F.coalesce(seen, F.lit(False))).alias("utilisation"), F.count_if(none).alias("missing"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select("*", share("retrieval", "failed").alias("retrieval_share"), share("utilisation", "failed").alias("utilisation_share"), share("failed", "total").alias("failed_share"))


def visible_evidence(evidence: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """Replay without looking ahead: for each question how much evidence of its own and earlier sessions there is.

    One running count over sessions takes the place of a join of every question with all its past.
    """
    from pyspark.sql.window import Window

    rows = evidence.select(*by, "session", F.lit(1).alias("e"), F.lit(None).cast("long").alias("question")).unionByName(questions.select(*by, "session", F.lit(0).alias("e"), F.col("question").cast("long")))
    seen = F.sum("e").over(Window.partitionBy(*by).orderBy("session").rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("visible", seen).where("question IS NOT NULL").select(*by, "question", "session", "visible")
