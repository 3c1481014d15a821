"""Greedy choices over a probe's few best candidates: diversity, near-duplicates, coverage. The caller bounds the candidates of a probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.lazy import pd
from mnemospark.functions.shared import dealt

CHOSEN = "probe long, id long, score double, rank int"


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def diverse(candidates: DataFrame, budget: int) -> DataFrame:
    """Of each probe's candidates (probe, id, score, topic, kind, importance, v) the next best again and again.

    A candidate loses 0.04 for each chosen one of its topic, 0.02 for each of its kind, and up to 0.08 for likeness over
    0.92 to a chosen one. Ties go to the more important, then to the larger id.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        v = _unit(np.stack([np.asarray(x, dtype=float) for x in rows["v"]]))
        like = v @ v.T
        left, out = list(range(len(rows))), []
        while left and len(out) < budget:
            def worth(i: int) -> tuple:
                same = sum(rows.topic[j] == rows.topic[i] for j in out), sum(rows.kind[j] == rows.kind[i] for j in out)
                near = max((like[i, j] for j in out), default=0.0)
                cost = min(0.08, near - 0.92) if near >= 0.92 else 0.0
                return round(rows.score[i] - 0.04 * same[0] - 0.02 * same[1] - cost, 9), rows.importance[i], rows.id[i]

            best = max(left, key=worth)
            out.append(best)
            left.remove(best)
        return pd.DataFrame({"probe": rows.probe[out], "id": rows.id[out], "score": rows.score[out], "rank": range(1, len(out) + 1)})

    return candidates.groupBy("probe").applyInPandas(pick, CHOSEN)


def covering(candidates: DataFrame, budget: int) -> DataFrame:
    """Of each probe's candidates (probe, id, score, need, protected): one for each need, then the protected, then a second for each need, then by score; shown by score."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        taken: list[int] = []

        def take(which: list[int]) -> None:
            for i in which:
                if len(taken) < budget and i not in taken:
                    taken.append(i)

        by_need = [list(g.index) for _, g in rows.groupby("need", sort=True)]
        take([g[0] for g in by_need])
        take(list(rows.index[rows.protected]))
        take([g[1] for g in by_need if len(g) > 1])
        take(list(rows.index))
        out = sorted(taken)
        return pd.DataFrame({"probe": rows.probe[out], "id": rows.id[out], "score": rows.score[out], "rank": range(1, len(out) + 1)})

    return candidates.groupBy("probe").applyInPandas(pick, CHOSEN)


def deduplicated(candidates: DataFrame, limit: float = 0.95) -> DataFrame:
    """Of each probe's candidates (probe, id, score, v; also starts, ends and sources, if there), from the best down, those
    that no chosen one is more like than `limit` at times that don't exclude each other.

    Columns: probe, id, score, rank and merged, the sources of the row and of those left out for it, sorted.
    """
    df = candidates
    for name, kind in (("starts", "string"), ("ends", "string"), ("sources", "array<string>")):
        df = df.withColumn(name, F.col(name).cast(kind)) if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = _unit(np.stack([np.asarray(x, dtype=float) for x in rows["v"]]))
        begin = [x if isinstance(x, str) else None for x in rows.starts]
        end = [x if isinstance(x, str) else b for x, b in zip(rows.ends, begin, strict=True)]
        apart = lambda i, j: None not in (begin[i], begin[j]) and (end[i] < begin[j] or end[j] < begin[i])
        of: dict[int, set] = {}
        for i in range(len(rows)):
            own = set(rows.sources[i]) if rows.sources[i] is not None else set()
            like = next((j for j in of if v[j] @ v[i] > limit and not apart(i, j)), None)
            if like is None:
                of[i] = own
            else:
                of[like] |= own
        out = list(of)
        return pd.DataFrame({"probe": rows.probe[out], "id": rows.id[out], "score": rows.score[out], "rank": range(1, len(out) + 1), "merged": [sorted(of[i]) for i in out]})

    return df.groupBy("probe").applyInPandas(pick, CHOSEN + ", merged array<string>")


def rescued(ranked: DataFrame, budget: int) -> DataFrame:
    """The first `budget` of each probe's rows (probe, id, rank, protected), with protected ones from below in place of
    unprotected ones: the best of those below takes the lowest such place, the next one the place above it, as long as there are any."""
    top, missing = ranked.where(F.col("rank") <= budget), ranked.where((F.col("rank") > budget) & F.col("protected"))
    by = lambda order: F.row_number().over(Window.partitionBy("probe").orderBy(order))
    free = top.where("NOT protected").select("probe", F.col("rank").alias("place"), by(F.desc("rank")).alias("n"))
    taken = missing.select("probe", F.col("id").alias("new"), by(F.col("rank")).alias("n")).join(free, ["probe", "n"]).select("probe", F.col("place").alias("rank"), "new")
    return top.join(taken, ["probe", "rank"], "left").select("probe", F.coalesce("new", "id").alias("id"), "rank", F.col("new").isNotNull().alias("rescued"))


def controller_evidence(candidates: DataFrame, needs: DataFrame, limit: int = 32, previous: int = 8) -> DataFrame:
    """What a planner is shown of each probe's candidates (probe, id, score, targets, cited, protected), in order of choice.

    Each of its required targets (needs: probe, targets in order) gets its best until two are shown; then come up to
    `previous` rows cited before, the protected ones, and the best of the rest, `limit` in all. A probe's rows stream by, best
    first, and a task keeps about `limit` of each kind of one probe.
    """

    best = F.when(~F.isnan("score"), F.col("score"))
    rows = candidates.join(needs.select("probe", F.col("targets").alias("needs")), "probe").select("probe", "id", "score", "targets", "cited", "protected", "needs")
    order = dealt(rows, "probe").sortWithinPartitions("probe", best.desc_nulls_last(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shown, out = None, None, []
        for b in batches:
            for probe, i, score, *row in zip(*(b.column(c).to_pylist() for c in ("probe", "id", "score", "targets", "cited", "protected", "needs")), strict=True):
                if shown is None or probe != at:
                    out += shown.chosen() if shown else []
                    at, shown = probe, _Shown(probe, row[3], limit, previous)
                shown.add(i, score, *row[:3])
            if len(out) >= 10_000:
                yield _shown(out)
                out = []
        yield _shown(out + (shown.chosen() if shown else []))

    return order.mapInArrow(run, CHOSEN)


def _shown(rows: list[tuple]) -> pa.RecordBatch:
    types = {"probe": pa.int64(), "id": pa.int64(), "score": pa.float64(), "rank": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


class _Shown:
    """One probe's rows as they come, best first: only those are kept that may still be chosen, whatever the others are."""

    def __init__(self, probe: int, needs: list | None, limit: int, previous: int):
        self.probe, self.limit, self.previous, self.n = probe, limit, previous, 0
        self.best: dict = {t: [] for t in needs or []}
        self.cited, self.protected, self.rest = [], [], []

    def add(self, i: int, score: float, targets: list | None, cited: bool | None, protected: bool | None) -> None:
        row = (self.n, i, score, frozenset(targets or ()))
        self.n += 1
        own = [self.best[t] for t in row[3] if t in self.best]
        for some, most in ((self.rest, self.limit), *((x, 2) for x in own), *(((self.cited, self.previous + 2 * len(self.best)),) if cited else ()), *(((self.protected, self.limit),) if protected else ())):
            if len(some) < most:
                some.append(row)

    def chosen(self) -> list[tuple]:
        out: dict[int, tuple] = {}
        for target, own in self.best.items():
            for row in own:
                if len(out) < self.limit:
                    out.setdefault(row[0], row)
                if sum(target in r[3] for r in out.values()) >= 2:
                    break
        again = [row for row in self.cited if row[0] not in out][: self.previous]
        for row in (*again, *self.protected, *self.rest):
            if len(out) < self.limit:
                out.setdefault(row[0], row)
        return [(self.probe, i, score, k) for k, (_, i, score, _) in enumerate(out.values(), 1)]


def reinforced(candidates: DataFrame, expansions: DataFrame, cited: DataFrame, step: float = 0.03, most: float = 0.06) -> DataFrame:
    """candidates (probe, id, score, reinforcement) whose expansions led to something cited gain `step` for each, up to `most`.

    expansions has probe, expansion, anchor, id (one row a result); cited has probe and id. An expansion counts once.
    """
    paid = expansions.join(cited.select("probe", "id").distinct(), ["probe", "id"], "left_semi").groupBy("probe", F.col("anchor").alias("id")).agg(F.countDistinct("expansion").alias("paid"))
    gain = F.least(F.lit(most), F.col("reinforcement") + step * F.coalesce("paid", F.lit(0)))
    return candidates.join(paid, ["probe", "id"], "left").withColumn("reinforcement", F.when(F.col("paid") > 0, gain).otherwise(F.col("reinforcement"))).drop("paid")
