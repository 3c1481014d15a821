"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, held_out, many_executions
from .stats import FEATURES, labelled, with_stats


PARTS = 8


@dataclass(frozen=True)
class Model:
    """Centre and scale of the statistics, the random features, the ridge weights and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    way: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    steps: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.way + self.shift), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.level), 0.0, 1.0)


def vector() -> Column:
    return F.array(*(F.col("_s")[f] for f in FEATURES))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to the means y of weight n: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for mean, weight in zip(y, n, strict=True):
        pools.append([mean, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, k = pools.pop()
            p = pools[-1]
            pools[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2] + k]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, width: int = 192, gamma: float = 0.15, ridge: float = 1e-3, bins: int = 200, seed: int = 7) -> Model:
    """Learns from at most fit_rows labelled documents outside the held-out fold.

    Four fifths of them go into the normal equations: each of PARTS partitions sends its sums, and Spark adds them cell
    by cell. The rest calibrate: their raw scores, in bins of equal counts, are made non-decreasing. gamma is the
    Gaussian kernel's parameter. Where so few rows are labelled that one of these parts has no row or one label only,
    all rows stand in for it. With one label only nothing can be told apart: every score is the share of
    label 1 then (0.5 without any label).
    """
    at = with_stats(labelled(carried(docs, ["doc_id", "text"], keep=[])[0], labels, fit_rows)).select("doc_id", "_y", "_s.*", vector().alias("_x"))
    rows = cut(at.withColumn("_fit", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) > 0))
    seen = rows.agg(F.avg("_y").alias("y"), *(F.avg(F.when(F.col("_fit") == own, F.col("_y"))).alias(n) for n, own in (("y_fit", True), ("y_rest", False))), *(F.avg(f).alias(f) for f in FEATURES), *(F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES)).first()
    rng = np.random.default_rng(seed)
    numbers = lambda names, other: np.array([float(f"{seen[c]:.9g}") if seen[c] else other for c in names], dtype=np.float64)
    blank = Model(numbers(FEATURES, 0.0), numbers([f"s_{f}" for f in FEATURES], 1.0), rng.normal(0, np.sqrt(2 * gamma), (len(FEATURES), width)), rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), np.zeros(1), np.array([0.5 if seen["y"] is None else seen["y"]]))
    if seen["y"] in (None, 0.0, 1.0):
        return blank
    own = rows if seen["y_fit"] in (None, 0.0, 1.0) else rows.where("_fit")
    rest = rows if seen["y_rest"] in (None, 0.0, 1.0) else rows.where("NOT _fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 2))
        for b in batches:
            x = blank.features(_matrix(b))
            total += x.T @ np.column_stack([x, b.column("_y").to_numpy(zero_copy_only=False)])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, part, dtype=np.int32)), pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["part", "cell", "v"])

    # what a partition holds, its order and the order of the partitions are fixed, so the last bits are too
    dealt = own.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "_y", *(F.col("_x")[i] for i in range(len(FEATURES))))
    summed = dealt.mapInArrow(sums, "part int, cell long, v double").groupBy("cell").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("part", "v"))), F.lit(0.0), lambda a, x: a + x["v"]).alias("v"))
    total = np.zeros((width + 1) * (width + 2))
    for c in summed.collect():  # (width + 1) * (width + 2) rows
        total[c["cell"]] = c["v"]
    total = total.reshape(width + 1, width + 2)
    weight = np.linalg.solve(total[:, :-1] + ridge * max(1.0, total[-1, -2]) / width * np.eye(width + 1), total[:, -1])
    model = Model(blank.centre, blank.scale, blank.way, blank.shift, weight, blank.steps, blank.level)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b))), b.column("_y").cast(pa.int32())], names=["raw", "y"])

    scored = cut(rest.mapInArrow(raws, "raw double, y int"))
    edges = scored.agg(F.percentile_approx("raw", [i / bins for i in range(1, bins)], 10_000).alias("q")).first()["q"]
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda c: F.col("raw") > c))
    held = scored.groupBy(place.alias("b")).agg(F.round(F.avg("raw"), 9).alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("x").collect()  # at most bins rows
    return Model(model.centre, model.scale, model.way, model.shift, weight, np.array([h["x"] for h in held]), isotonic(np.array([h["y"] for h in held]), np.array([h["n"] for h in held])))


def quality_scores(docs: DataFrame, labels: DataFrame, predict_at: float = 0.7, keep: list[str] | None = None, **how) -> DataFrame:
    """docs (its columns `keep`, all by default) with held_out, score (0 to 1; higher: label 1 likelier) and predicted (1 from predict_at on).

    Needs doc_id and text; other columns pass, save those with the result's names in any case. The score comes from statistics of
    the whole text alone; a null text counts as empty and is scored too. Repeated rows get equal scores; a null
    doc_id counts as not held out; an empty table gives no rows.
    """
    with many_executions(docs.sparkSession):
        model = fit(docs, labels, **how)
    df, back = carried(docs, ["doc_id", "text"], ["held_out", "score", "predicted"], keep)
    own = [c for c in df.columns if c != "text" or keep is None or "text" in keep]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.round(model.score(_matrix(b)), 9) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(score)], names=[*own, "_score"])

    schema = df.select(*own).withColumn("_score", F.lit(0.0)).schema
    df = with_stats(df).select(*own, vector().alias("_x")).mapInArrow(scores, schema)
    return df.select(*back, held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= predict_at).cast("int").alias("predicted"))
