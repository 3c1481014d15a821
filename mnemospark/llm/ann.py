"""Approximate nearest neighbours: stable projections to few dimensions, a kd-tree over them, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, stored

#: How many cells, nearest first, a query may have visited after each round; None for all that the test lets through.
ROUNDS = (1, 8, None)


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The distribution function with m degrees of freedom, m even."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for j in range(1, m // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


@dataclass(frozen=True)
class Space:
    """Where vectors are projected to: inner product becomes distance by one more component, sqrt(norm^2 - |v|^2), a
    query's being 0; Gaussian projections of that to m dimensions keep distances: |Px - Pq|^2 / |x - q|^2 is chi-square
    with m degrees of freedom."""

    norm: float
    way: np.ndarray
    sure: float

    @property
    def m(self) -> int:
        return self.way.shape[1]

    def rows(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.norm * self.norm - (v * v).sum(axis=1), 0))]) @ self.way

    def queries(self, v: np.ndarray) -> np.ndarray:
        return v @ self.way[:-1]

    def ends(self, bound: np.ndarray, square: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Whether the search may end before what lies `bound` (squared, projected) away: a vector as near as the k-th
        best so far (score kth; -inf without) would, with probability `sure`, have been projected nearer."""
        far = np.maximum(square + self.norm * self.norm - 2 * np.where(np.isfinite(kth), kth, 0.0), 1e-12)
        return np.isfinite(kth) & (chi_square(bound / far, self.m) >= self.sure)


def apart(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of points to boxes, row by row."""
    return (np.maximum(np.maximum(low - points, points - high), 0) ** 2).sum(axis=-1)


@dataclass(frozen=True)
class Tree:
    """A kd-tree as levels of boxes: node j of a level has nodes 2j and 2j + 1 of the next; leaf j has order[edges[j]:edges[j + 1]]."""

    order: np.ndarray
    edges: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, points: np.ndarray, leaf: int) -> Tree:
        order, edges = np.arange(len(points)), [0, len(points)]
        while max(b - a for a, b in zip(edges, edges[1:], strict=False)) > leaf:
            new = [0]
            for a, b in zip(edges, edges[1:], strict=False):
                own = points[order[a:b]]
                mid = (b - a) // 2
                side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
                new += [a + mid, b]
            edges = new
        low, high = (np.array([f(points[order[a:b]], axis=0) for a, b in zip(edges, edges[1:], strict=False)]) for f in (np.min, np.max))
        levels = [(low, high)]
        while len(levels[0][0]) > 1:
            low, high = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        return cls(order, np.array(edges), levels)

    def descended(self, points: np.ndarray, going) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, bound), by query and then bound: the leaves that a descent reaches; going(query, bound) says on where."""
        who, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        for depth, (low, high) in enumerate(self.levels):
            if depth:
                who, node = np.repeat(who, 2), (2 * node[:, None] + np.arange(2)).ravel()
            bound = apart(points[who], low[node], high[node])
            on = going(who, bound)
            who, node, bound = who[on], node[on], bound[on]
        at = np.lexsort((bound, who))
        return who[at], node[at], bound[at]


def search_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, space: Space, leaf: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, inner product) of each query's k best found in one block, and how many products were made.

    floor is the k-th best score that a query has already. The tree is descended only where the stopping test lets the
    query on; leaves come in order of projected distance, and a query's search ends at the first that fails the test,
    with the k-th best so far.
    """
    tree = Tree.of(space.rows(vectors), leaf)
    square = (queries * queries).sum(axis=1)
    who, leaves, bound = tree.descended(space.queries(queries), lambda q, b: ~space.ends(b, square[q], floor[q]))
    begin, end = np.searchsorted(who, np.arange(len(queries))), np.searchsorted(who, np.arange(len(queries)), side="right")
    best, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    active, turn, made = np.flatnonzero(begin < end), 0, 0
    while len(active):
        at = leaves[begin[active] + turn]
        groups = np.argsort(at, kind="stable")
        for own in np.split(groups, np.flatnonzero(np.diff(at[groups])) + 1):
            some, j = active[own], at[own[0]]
            rows = tree.order[tree.edges[j] : tree.edges[j + 1]]
            score = queries[some] @ vectors[rows].T
            made += score.size
            better = np.flatnonzero((score >= np.maximum(best[some, -1], floor[some])[:, None]).any(axis=1))
            some = some[better]
            both, names = np.concatenate([best[some], score[better]], axis=1), np.concatenate([found[some], np.broadcast_to(rows, (len(some), len(rows)))], axis=1)
            spot = np.lexsort((np.where(names >= 0, ids[names], np.iinfo(np.int64).max), -both), axis=1)[:, :k]
            best[some], found[some] = np.take_along_axis(both, spot, axis=1), np.take_along_axis(names, spot, axis=1)
        turn += 1
        active = active[begin[active] + turn < end[active]]
        active = active[~space.ends(bound[begin[active] + turn], square[active], np.maximum(best[active, -1], floor[active]))]
    q, r = np.nonzero(np.isfinite(best))
    rows = found[q, r]
    cuts = range(0, len(q), 50_000)
    exact = np.concatenate([(queries[q[i : i + 50_000]] * vectors[rows[i : i + 50_000]]).sum(axis=1) for i in cuts]) if len(q) else np.zeros(0)
    return q, rows, exact, made


@dataclass(frozen=True)
class Cells:
    """The upper part of the kd-tree, which deals rows to cells: at node i (its children are 2i + 1 and 2i + 2) side[i] is
    compared with at[i]. Fitted on a sample; every row has a cell."""

    depth: int
    side: np.ndarray
    at: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, depth: int) -> Cells:
        side, at = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
        groups = [sample]
        for i in range(len(side)):
            own = groups[i]
            if len(own):
                side[i] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                at[i] = np.median(own[:, side[i]])
            right = own[:, side[i]] >= at[i]
            groups += [own[~right], own[right]]
        return cls(depth, side, at)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.side[node]] >= self.at[node])
        return node - ((1 << self.depth) - 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, m: int = 8, sure: float = 0.5, block: int = 16_384, query_block: int = 4_096, fit_rows: int = 20_000, most_cells: int = 4_096, seed: int = 11, made: Accumulator | None = None
) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by `every`, its k nearest other rows.

    Nearest is the largest inner product, in double precision; ties go to the smaller vec_id. The search is
    approximate: `sure` is the chi-square level at which a query stops. It can be low, as the box of what is next lies
    nearer than what is in it: at 0.5 recall was 0.99 and more where nothing has structure. `made` counts the products, if given.

    1. Equal vectors are one row, with their k + 1 smallest ids, as more can't be among anyone's k nearest.
    2. A kd-tree over projections to m dimensions, fitted on fit_rows rows (those with the smallest hashes of their ids),
       deals every row to one of up to most_cells cells of about `block`; a cell that holds more is dealt on by hash.
    3. In each round every query goes to its next cells, nearest first, unless the test ends its search there; a visit
       builds the cell's own tree and descends it, and the k best are carried to the next round. So a query's work is
       that of the cells that the test lets it visit, whatever the number of rows; only where projections tell nothing
       apart (vectors without structure) are these all. Both sides of a visit are bounded.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null vec_ids and vectors
    whose length differs from that of the smallest vec_id's. Of repeated vec_ids the smallest vector counts. Fewer than k
    others give all of them; an empty table gives no rows; other columns are ignored.
    """
    spark, shape = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    doubles = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    good = carried(vectors, ["vec_id", "embedding"], keep=[])[0].select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    good = stored(good.groupBy("vec_id").agg(F.min("v").alias("v")))
    seen = good.agg(F.min(F.struct("vec_id", F.size("v").alias("n"))).alias("first")).first()["first"]
    if seen is None:
        return spark.createDataFrame([], shape)
    good = good.where(F.size("v") == seen["n"])
    few = good.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    kinds = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("c"), "ids", "v"))
    named = stored(good.where(F.col("vec_id") % every == 0).join(kinds.select("c", "v"), "v").select(F.col("vec_id").alias("query_id"), "c"))
    asked = stored(named.select("c").distinct().join(kinds.select("c", "v"), "c"))

    size = kinds.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    space = Space(math.sqrt(size["norm2"]), np.random.default_rng(seed).normal(size=(seen["n"] + 1, m)), sure)
    depth = min(max(0, math.ceil(math.log2(size["n"] / block))), most_cells.bit_length() - 1)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = space.rows(_matrix(b.column("v"))) if b.num_rows else np.zeros((0, m))
            yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float64()))], names=["p"])

    sample = kinds.orderBy(F.xxhash64("c"), "c").limit(fit_rows).select("v").mapInArrow(projected, "p array<double>").collect() if depth else []
    cells = Cells.fitted(np.array([r["p"] for r in sample]).reshape(-1, m), depth)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = space.rows(_matrix(b.column("v"))) if b.num_rows else np.zeros((0, m))
            yield pa.RecordBatch.from_arrays([pa.array(cells.of(p), pa.int32()), *(b.column(c) for c in ("c", "ids", "v")), pa.array(list(p), pa.list_(pa.float64()))], names=["cell", "c", "ids", "v", "p"])

    rows = stored(kinds.mapInArrow(located, "cell int, c long, ids array<long>, v array<double>, p array<double>"))
    boxes = rows.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("p")[i]).alias(f"{side}{i}") for side, f in (("low", F.min), ("high", F.max)) for i in range(m))).orderBy("cell").collect()  # at most most_cells
    numbers, counts = np.array([r["cell"] for r in boxes]), np.array([r["n"] for r in boxes])
    low, high = (np.array([[r[f"{side}{i}"] for i in range(m)] for r in boxes]) for side in ("low", "high"))
    parts = -(-counts // (2 * block))

    def visits(first: int, last: int):
        def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                    v, kth = _matrix(b.column("v")), b.column("kth").to_numpy()
                    bound = apart(space.queries(v)[:, None, :], low[None], high[None])
                    order = np.argsort(bound, axis=1, kind="stable")[:, first:last]
                    on = ~space.ends(np.take_along_axis(bound, order, axis=1), (v * v).sum(axis=1)[:, None], kth[:, None])
                    q, spot = np.nonzero(on)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[order[q, spot]], pa.int32()), *(b.column(c).take(pa.array(q)) for c in ("c", "v", "kth"))], names=["cell", "c", "v", "kth"])

        return planned

    def visited(own: pa.Table, asks: pa.Table) -> pa.Table:
        if len(own) and len(asks):
            own, asks = own.sort_by("c"), asks.sort_by("c")
            q, r, score, n = search_block(own.column("c").to_numpy(), _matrix(own.column("v")), _matrix(asks.column("v")), asks.column("kth").to_numpy(), k + 1, space)
            if made is not None:
                made.add(n)
        else:
            q, r, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        return pa.table({"q": asks.column("c").take(pa.array(q)), "c": own.column("c").take(pa.array(r)), "ids": own.column("ids").take(pa.array(r)), "score": pa.array(score)})

    best, first = None, 0
    state = asked.withColumn("kth", F.lit(float("-inf")))
    for width in ROUNDS:
        last = len(numbers) if width is None else min(width, len(numbers))
        if first >= last:
            break
        asks = stored(state.mapInArrow(visits(first, last), "cell int, c long, v array<double>, kth double"))
        load = {r["cell"]: -(-r["n"] // query_block) for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most most_cells
        first = last
        if not load:
            break
        plan = F.broadcast(spark.createDataFrame([(int(c), int(p), int(load[c])) for c, p in zip(numbers, parts, strict=True) if c in load], "cell int, parts int, loads int"))
        there = rows.select("cell", "c", "ids", "v").join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).withColumn("load", F.explode(F.sequence(F.lit(0), F.col("loads") - 1)))
        asks = asks.join(plan, "cell").withColumn("load", F.pmod(F.xxhash64("c"), F.col("loads")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        by = ["cell", "part", "load"]
        found = there.select(*by, "c", "ids", "v").groupBy(*by).cogroup(asks.select(*by, "c", "v", "kth").groupBy(*by)).applyInArrow(visited, "q long, c long, ids array<long>, score double")
        found = found if best is None else best.unionByName(found)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
        best = stored(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"))
        # the k + 1 nearest ids may be those of fewer rows
        kth = best.withColumn("n", F.sum(F.size("ids")).over(order)).groupBy("q").agg(F.max(F.when(F.col("n") > k, F.col("score"))).alias("s"))
        state = asked.join(kth, F.col("c") == F.col("q"), "left").select("c", "v", F.coalesce("s", F.lit(float("-inf"))).alias("kth"))

    near = best.select("q", F.explode("ids").alias("vec_id"), "score").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("near"))
    answers = named.join(near, F.col("c") == F.col("q")).withColumn("near", F.expr("filter(near, x -> x.vec_id <> query_id)"))
    return answers.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
