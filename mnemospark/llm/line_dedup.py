"""Line dedup by pairwise alignment: shared line hashes find the pairs, patience diff aligns them, common blocks go."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, stored


def rare_keys(hashes: list[int], words: list[int], least: int) -> list[int]:
    """For each line: hashes of it with as many following, and with as many preceding, lines as make up `least` words.

    A line of that many words stands by itself. Short lines recur everywhere, so only their run is rare enough. Runs
    that are too short at the document's ends don't count. Every line of a common block of `least` words or more lies in
    a run within the block: those that end there reach the lines after the last one that begins there.
    """
    flat = np.array(hashes, dtype=np.int64)
    return [xxhash.xxh3_64_intdigest(flat[i:j].tobytes()) - (1 << 63) for i, j in runs_of(words, least)]


def runs_of(words: list[int], least: int) -> list[tuple[int, int]]:
    """Begin and end of the shortest runs of `least` words or more that begin, or end, at each line."""
    ends = np.cumsum([0, *words])
    stops = np.searchsorted(ends, ends[:-1] + least).tolist()
    starts = (np.searchsorted(ends, ends[1:] - least, side="right") - 1).tolist()
    return sorted({(i, j) for i, j in enumerate(stops) if j < len(ends)} | {(i, j + 1) for j, i in enumerate(starts) if i >= 0})


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal lines, rising in both: the longest such chain over lines that are unique in both, grown
    at its ends, and the same in between; where no line is unique there, the n-th of its kind meets the n-th."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), False)]
    while todo:
        lo_a, hi_a, lo_b, hi_b, nth = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        if lo_a == hi_a or lo_b == hi_b:
            continue
        if nth:
            left, right = (_numbered(x[lo:hi]) for x, lo, hi in ((a, lo_a, hi_a), (b, lo_b, hi_b)))
        else:
            once_a, once_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
            left = {x: i for i, x in enumerate(a[lo_a:hi_a]) if once_a[x] == 1}
            right = {x: i for i, x in enumerate(b[lo_b:hi_b]) if once_b[x] == 1}
        chain = _rising([(i, right[x]) for x, i in left.items() if x in right])
        if not chain:
            if not nth and set(a[lo_a:hi_a]) & set(b[lo_b:hi_b]):
                todo.append((lo_a, hi_a, lo_b, hi_b, True))
            continue
        if nth:  # every line that recurs has met its like; what is left between isn't common in this order
            out += [(lo_a + i, lo_b + j) for i, j in chain]
            continue
        edges = [(-1, -1), *chain, (hi_a - lo_a, hi_b - lo_b)]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            todo.append((lo_a + i + 1, lo_a + k, lo_b + j + 1, lo_b + m, False))
        out += [(lo_a + i, lo_b + j) for i, j in chain]
    return sorted(out)


def _numbered(lines: list) -> dict:
    seen: Counter = Counter()
    out = {}
    for i, x in enumerate(lines):
        out[x, seen[x]] = i
        seen[x] += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (in order of their first) whose second rises."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[k], at[k] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def common_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Places in b of lines in blocks that lie together in both, of at least `least` words in all.

    Aligned lines are set aside and the rest is aligned again, so blocks in another order are found too, as long as an
    alignment takes a quarter of the lines that both have left: the work is then that of few alignments. Blocks that are
    left by then, or that an alignment broke up, are looked up by their runs, which both have: every line of a common
    block lies in one (see rare_keys), so the result is whole either way.
    """
    if a == b:
        return list(range(len(b))) if sum(words) >= least else []
    of = dict(zip(b, words, strict=True))
    sizes = [of.get(x, least) for x in a]
    there = {_digest(a, i, j) for i, j in runs_of(sizes, least)}
    gone = {n for i, j in runs_of(words, least) if _digest(b, i, j) in there for n in range(i, j)}
    a, b = list(a), list(b)
    while True:
        pairs = patience(a, b)
        begin = 0
        for n in range(1, len(pairs) + 1):
            if n == len(pairs) or pairs[n] != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
                block = [j for _, j in pairs[begin:n]]
                if sum(words[j] for j in block) >= least:
                    gone.update(block)
                begin = n
        for n, (i, j) in enumerate(pairs):
            a[i], b[j] = ("a", i, n), ("b", j, n)  # equal to nothing
        both = set(a).intersection(b)
        if not both or 4 * len(pairs) < len(pairs) + sum(x in both for x in b):
            return sorted(gone)


def _digest(lines: list[int], i: int, j: int) -> bytes:
    return xxhash.xxh3_128_digest(np.array(lines[i:j], dtype=np.int64).tobytes())


def line_dedup(docs: DataFrame, least_words: int = 50, pairs_a_task: int = 20_000) -> DataFrame:
    """docs with text less the blocks of lines that an earlier document has, n_lines, removed_lines and removed_words.

    Lines are what lies between \n, without white space at either end; lines without words don't count and stay.
    Earlier means of smaller doc_id. What makes lines rare is their length: a run of lines with at least least_words
    words hardly ever recurs by chance, while a single short line ("Home", a greeting) recurs everywhere, and deleting it
    would hurt clean documents; so runs, forwards and backwards, are the keys, and each line of a block that any earlier
    document has is in one. A run that is in several documents pairs each of them with the first that has it, so pairs
    grow with the documents and not with their square, and nothing is capped. Patience diff aligns each pair, and aligned
    blocks of least_words words or more are deleted from the later one. What is deleted stays in the first document
    that has it. Pairs of one first document are dealt to tasks of about pairs_a_task.

    Needs doc_id and text; other columns pass, and columns of the result's names, in any case, are replaced. A null text
    stays null. Rows with a null doc_id pass untouched; rows of one doc_id are not compared with each other, and get
    their deletions by doc_id and text. An empty table gives no rows.
    """
    df, back = carried(docs, ["doc_id", "text"], ["n_lines", "removed_lines", "removed_words"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text in b.column("text").to_pylist():
                lines = [(n, line.strip()) for n, line in enumerate((text or b"").split(b"\n"))]
                lines = [(n, line) for n, line in lines if line]
                hashes, words = [xxhash.xxh3_64_intdigest(line) - (1 << 63) for _, line in lines], [len(line.split()) for _, line in lines]
                for column, v in zip(out, (hashes, words, [n for n, _ in lines], rare_keys(hashes, words, least_words)), strict=True):
                    column.append(v)
            arrays = [pa.array(c, pa.list_(t)) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_v"), *arrays], names=["doc_id", "_v", "hashes", "words", "places", "keys"])

    source = df.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_v"), F.col("text").cast("binary"))
    lines = stored(source.mapInArrow(read, "doc_id long, _v long, hashes array<long>, words array<int>, places array<int>, keys array<long>"))
    runs = lines.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
    shared = runs.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    pairs = stored(runs.join(shared, "key").where("first < doc_id").select("first", "doc_id").distinct())
    # a first document that many others meet is dealt to as many tasks as its pairs need
    salts = 1 + pairs.count() // pairs_a_task
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    earlier = pairs.select("first", "salt").distinct().join(lines.select(F.col("doc_id").alias("first"), F.col("hashes").alias("a")), "first")
    later = lines.select("doc_id", "_v", F.col("hashes").alias("b"), "words", "places")
    both = pairs.join(earlier, ["first", "salt"]).join(later, "doc_id").select("doc_id", "_v", "a", "b", "words", "places")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], []]
            for x, y, words, places in zip(*(b.column(c).to_pylist() for c in ("a", "b", "words", "places")), strict=True):
                gone = common_blocks(x, y, words, least_words)
                out[0].append([places[j] for j in gone])
                out[1].append([words[j] for j in gone])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_v"), *(pa.array(c, pa.list_(pa.int32())) for c in out)], names=["doc_id", "_v", "places", "words"])

    found = both.mapInArrow(aligned, "doc_id long, _v long, places array<int>, words array<int>").where(F.size("places") > 0)
    met = found.groupBy("doc_id", "_v").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("places", "words")))).alias("gone"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags, words = [], []
            for gone in b.column("gone").to_pylist():
                own = np.zeros(max(g["places"] for g in gone) + 1, dtype=bool)
                own[[g["places"] for g in gone]] = True
                flags.append(own.tolist())
                words.append(sum(g["words"] for g in gone))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_v"), pa.array(flags, pa.list_(pa.bool_())), pa.array(words, pa.int64())], names=["_d", "_v", "_gone", "removed_words"])

    gone = met.mapInArrow(marked, "_d long, _v long, _gone array<boolean>, removed_words long")
    df = df.withColumn("_v", F.xxhash64("text")).withColumn("_dl", F.col("doc_id").cast("long"))
    df = df.join(gone.withColumnRenamed("_v", "_w"), (F.col("_dl") == F.col("_d")) & (F.col("_v") == F.col("_w")), "left").withColumn("_lines", F.split("text", "\n"))
    left = F.filter("_lines", lambda _, i: ~F.coalesce(F.get(F.col("_gone"), i), F.lit(False)))
    df = df.select(
        *(c for c in df.columns if c not in {"text", "_gone", "_lines", "removed_words"}),
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("_n"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size(F.filter("_gone", lambda g: g))).cast("long").alias("_removed"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("_words"),
    )
    return df.select(*back, F.col("_n").alias("n_lines"), F.col("_removed").alias("removed_lines"), F.col("_words").alias("removed_words"))
