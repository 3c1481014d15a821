"""Exact nearest vectors by cosine without all products: cells around centres, bounded by the triangle inequality of angles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.shared import stored

from .search import ranked

#: Scores are rounded to six digits; what may round up to a bound is still looked at.
SLACK = 2e-6


@dataclass
class Cells:
    """rows: (id, u, cell, angle) as a stored table in order of cell, u the vector at length 1; centres at length 1; of
    each cell how many rows it has and between which angles to its centre they lie."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; a null one is all zero."""
    flat, lengths = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    d = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(column), d))
    out[lengths == d] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d) if d else 0.0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _fitted(sample: np.ndarray, cells: int, turns: int = 8) -> np.ndarray:
    """Centres by spherical k-means; it starts from rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(turns):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        moved = _unit(sums)
        centres = np.where(moved.any(axis=1, keepdims=True), moved, centres)
    return centres


def celled(vectors: DataFrame, cells: int | None = None, sample: int = 20_000) -> Cells:
    """Deals vectors (id, v), all of one length, to cells: by default as many as the root of their number, 1,024 at most.

    The centres are fitted on at most `sample` rows, those of the smallest hashes; they only decide how much is looked
    at, never what is found. Every row gets a cell; zero and null vectors have one of their own, with cosine 0 to all.
    """
    rows = vectors.select("id", "v")
    cells = cells or max(1, min(1024, int(rows.count() ** 0.5)))
    some = rows.where("v IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    some = _unit(_matrix(some)) if len(some) else np.zeros((0, 1))
    some = some[some.any(axis=1)]
    centres = _fitted(some, min(cells, len(some))) if len(some) else np.zeros((0, some.shape[1]))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column("v")))
            like = u @ c.T if len(c) and u.shape[1] else np.zeros((len(u), 1))
            cell = np.where(u.any(axis=1), like.argmax(axis=1), len(c))
            angle = np.where(cell < len(c), np.arccos(np.clip(like.max(axis=1), -1, 1)), 0.0)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * u.shape[1]), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "u", "cell", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = stored(rows.mapInArrow(placed, f"id {kind}, u array<double>, cell int, angle double").repartitionByRange("cell", "id").sortWithinPartitions("cell", "angle"))
    sizes, low, high = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres) + 1), np.zeros(len(centres) + 1)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a cell
        sizes[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    return Cells(dealt, centres, sizes, low, high)


def _least(probes: np.ndarray, cells: Cells) -> np.ndarray:
    """The least angle that a row of each cell can have to each probe: angles obey the triangle inequality."""
    to = np.arccos(np.clip(probes @ cells.centres.T, -1, 1)) if len(cells.centres) else np.zeros((len(probes), 0))
    bound = np.maximum(np.maximum(to - cells.high[:-1], cells.low[:-1] - to), 0.0)
    return np.concatenate([bound, np.full((len(probes), 1), np.pi / 2)], axis=1)  # zero vectors


def _scanned(cells: Cells, names: pa.Array, kind: str, probes: np.ndarray, visits: np.ndarray, best: np.ndarray, k: int) -> DataFrame:
    """probe, id, score: of each probe and task the k best in the cells it visits that reach `best`."""
    spark = cells.rows.sparkSession
    shared = spark.sparkContext.broadcast((names, probes, visits, best))
    some = np.flatnonzero(visits.any(axis=0)).tolist()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probes, visits, best = shared.value
        best = best.copy()
        held: dict[int, list[tuple[np.ndarray, pa.Array]]] = {}

        def cut(i: int) -> tuple[np.ndarray, pa.Array]:
            score, ids = np.concatenate([s for s, _ in held[i]]), pa.concat_arrays([x for _, x in held[i]])
            order = pa.compute.sort_indices(pa.table({"s": pa.array(-score), "id": ids}), sort_keys=[("s", "ascending"), ("id", "ascending")]).slice(0, k)
            score, ids = score[order.to_numpy()], ids.take(order)
            if len(score) == k:
                best[i] = max(best[i], score[-1])
            held[i] = [(score, ids)]
            return held[i][0]

        for b in batches:
            if not b.num_rows:
                continue
            u, cell = _matrix(b.column("u")), b.column("cell").to_numpy()
            for at in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
                asked = np.flatnonzero(visits[:, cell[at[0]]])
                if not len(asked):
                    continue
                score = np.round(np.clip(u[at] @ probes[asked].T, 0.0, 1.0), 6)
                hit = score >= best[asked]
                for j in np.flatnonzero(hit.any(axis=0)).tolist():
                    own = np.flatnonzero(hit[:, j])
                    held.setdefault(int(asked[j]), []).append((score[own, j], b.column("id").take(pa.array(at[own]))))
                    if sum(len(s) for s, _ in held[int(asked[j])]) > 4 * k:
                        cut(int(asked[j]))
        for i in held:
            score, ids = cut(i)
            yield pa.RecordBatch.from_arrays([names.take(pa.array([i] * len(score))), ids, pa.array(score)], names=["probe", "id", "score"])

    id_kind = cells.rows.schema["id"].dataType.simpleString()
    return cells.rows.where(F.col("cell").isin(some)).mapInArrow(found, f"probe {kind}, id {id_kind}, score double")


def topk(probes: DataFrame, cells: Cells, k: int, most: int = 2_048) -> tuple[DataFrame, float]:
    """(probe, id, score, rank): the k nearest rows by cosine (0 at least, to six digits) of every probe (probe, pv), ties
    to the smaller id, exactly; and the share of all products that was made.

    Blocks of about `most` probes at a time: first each probe visits the cells that can lie nearest until they hold k
    rows. The k-th best score there bounds the rest: only cells that can hold a row as near as that are visited then. Tasks keep
    k rows a probe. A null or zero probe has cosine 0 to all.
    """
    blocks, found, made, total = 1 + probes.count() // most, None, 0, 0
    kind = probes.schema["probe"].dataType.simpleString()
    for i in range(blocks):
        own = probes if blocks == 1 else probes.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == i)
        block = own.select("probe", "pv").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        names, q = block["probe"].combine_chunks(), _unit(_matrix(block["pv"].combine_chunks()))
        if q.shape[1] != cells.centres.shape[1]:
            q = np.zeros((len(q), cells.centres.shape[1]))
        least = _least(q, cells)
        least[~q.any(axis=1)] = np.pi / 2
        least[:, cells.sizes == 0] = np.inf
        order = least.argsort(axis=1, kind="stable")
        before = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
        first = np.zeros(least.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= np.isfinite(least)
        near = stored(ranked(_scanned(cells, names, kind, q, first, np.zeros(len(q)), k), ["probe"], [F.desc("score"), F.col("id")], k).drop("rank"))
        bound = {r.probe: r.worst for r in near.groupBy("probe").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k).collect()}  # a row a probe
        best = np.array([bound.get(p, 0.0) for p in names.to_pylist()])
        rest = ~first & (np.cos(np.minimum(least, np.pi)) >= best[:, None] - SLACK) & np.isfinite(least)
        made += int(((first | rest) * cells.sizes).sum())
        total += len(q) * int(cells.sizes.sum())
        if rest.any():
            near = near.unionByName(_scanned(cells, names, kind, q, rest, best, k))
        near = ranked(near, ["probe"], [F.desc("score"), F.col("id")], k)
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = cells.rows.sparkSession.createDataFrame([], f"probe {kind}, id {cells.rows.schema['id'].dataType.simpleString()}, score double, rank long")
    return found, made / total if total else 0.0
