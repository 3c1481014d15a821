"""Retrieval in rounds, for all questions at once: search, expand over edges, stop where nothing grows, rerank, select."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.shared import shared_dir, stored

from .graph import expand
from .search import ranked

Reranker = Callable[[DataFrame], DataFrame]


def scaled(value: Column, by: str) -> Column:
    """From 0 to 1 within each group; all 0 where the group is flat."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low <= 1e-12, 0.0).otherwise((value - low) / (high - low))


def retrieve(found: DataFrame, edges: DataFrame, relevance: DataFrame, rounds: int = 8, anchors: int = 4, budget: int = 4, limit: int = 16, barren: int = 2, rerank: Reranker | None = None) -> DataFrame:
    """probe, id, hop, score, rank: what each probe retrieves after at most `rounds` rounds of expansion.

    found (probe, id, score) is the first search. In a round each probe's best `anchors` candidates that were no anchors
    before reach their `budget` best neighbours; each hop costs 0.08. A probe that finds nothing new in `barren` rounds
    on end drops out, and the loop ends when all have. At the end relevance (probe, node, rel), or what `rerank` makes of the candidates
    (probe, id, rel), counts 0.7 and the scaled retrieval score 0.3. Each round is written to spark.checkpoint.dir.
    """
    edges, relevance = stored(edges), stored(relevance)  # every round reads them
    pool = found.select("probe", "id", F.lit(0).alias("hop"), F.col("score").cast("double").alias("score"), F.lit(False).alias("used")).checkpoint()
    growing = pool.select("probe").distinct().withColumn("idle", F.lit(0))
    for turn in range(1, rounds + 1):
        fresh = pool.where("NOT used").join(growing, "probe", "left_semi")
        chosen = ranked(fresh, ["probe"], [F.desc("score"), F.col("id")], anchors).select("probe", F.col("id").alias("anchor"), "score")
        reached = expand(chosen, edges, relevance, budget).groupBy("probe", F.col("node").alias("id")).agg(F.max("score").alias("score"))
        new = reached.join(pool.select("probe", "id"), ["probe", "id"], "left_anti").select("probe", "id", F.lit(turn).alias("hop"), F.round(F.col("score") - 0.08 * turn, 6).alias("score"), F.lit(False).alias("used")).checkpoint()
        marks = chosen.select("probe", F.col("anchor").alias("id"), F.lit(True).alias("now"))
        pool = pool.join(marks, ["probe", "id"], "left").select("probe", "id", "hop", "score", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used")).unionByName(new).checkpoint()
        found_some = new.select("probe").distinct().withColumn("some", F.lit(True))
        growing = growing.join(found_some, "probe", "left").select("probe", F.when(F.col("some"), 0).otherwise(F.col("idle") + 1).alias("idle")).where(F.col("idle") < barren).checkpoint()
        if not growing.limit(1).count():
            break
    rel = rerank(pool) if rerank else relevance.select("probe", F.col("node").alias("id"), "rel")
    both = pool.join(rel, ["probe", "id"], "left").withColumn("final", F.round(0.7 * F.coalesce("rel", F.lit(0.0)) + 0.3 * scaled(F.col("score"), "probe"), 6))
    return ranked(both.select("probe", "id", "hop", F.col("final").alias("score")), ["probe"], [F.desc("score"), F.col("id")], limit)


#: How much each way of looking up a node counts.
LOOKUP_PRIOR = {"ENTITY_LOOKUP": 0.65, "CROSS_ENTITY_LOOKUP": 0.80, "TIME_OVERLAP_LOOKUP": 0.85, "TEMPORAL_BEFORE_LOOKUP": 0.80, "TEMPORAL_AFTER_LOOKUP": 0.80, "NEAREST_TIME_LOOKUP": 0.70}


def navigation_score(relevance: Column, coverage: Column, proximity: Column, confidence: Column, action: Column) -> Column:
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    prior = F.lit(0.5)
    for name, value in LOOKUP_PRIOR.items():
        prior = F.when(action == name, value).otherwise(prior)
    return 0.40 * unit(relevance) + 0.25 * unit(coverage) + 0.20 * unit(proximity) + 0.10 * unit(confidence) + 0.05 * prior


def undelivered(cited: DataFrame, delivered: DataFrame) -> DataFrame:
    """Probes that cite (probe, id) what was not delivered, and how much: their answers count as unsupported."""
    return cited.join(delivered.select("probe", "id"), ["probe", "id"], "left_anti").groupBy("probe").agg(F.count("*").alias("missing"))
