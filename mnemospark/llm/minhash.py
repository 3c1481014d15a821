"""Near-duplicate documents: b-bit MinHash over word shingles, verified on full sets, linked into components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, components, cut, many_executions, release, sized_join, stored

ROWS = 4  # minima in a band
BITS = 2  # low bits kept of each minimum
MERSENNE = np.uint64((1 << 61) - 1)


class WordHashes(dict):
    """64-bit hashes of words, kept until there are many."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 150_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of `size` words, sorted; of the whole sequence if it has fewer; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k, out = min(size, len(words)), np.full(max(1, len(words) - size + 1), min(size, len(words)), dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def bands_for(share: float, missed: float = 1e-6) -> int:
    """Bands of ROWS minima that a pair of this similarity all escapes with probability `missed` at most."""
    return math.ceil(math.log(missed) / math.log1p(-(share**ROWS)))


def _keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(own: np.ndarray, mul: np.ndarray, add: np.ndarray, step: int = 2048) -> np.ndarray:
    """The minimum of a set under each hash function, in blocks of the set."""
    best = np.full(len(mul), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), step):
        h = own[None, i : i + step] * mul[:, None]
        h += add[:, None]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        np.minimum(best, h.min(axis=1), out=best)
    return best


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: what is made of them stays small too."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        release()


def _folded(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _content(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def sketches(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, content (128-bit digest of the words), bands (a hash of each) and bits (packed low bits) of
    each row of docs (doc_id, text); without words or text n_shingles is 0 and the others are null."""
    mul, add = _keys(bands * ROWS)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in _slices(batches):
            n, content, keys, bits = [], [], [], []
            for text in b.column(1).to_pylist():
                words = _folded(text)
                own = shingles(words, size, hashes)
                n.append(len(own))
                content.append(_content(words))
                if not len(own):
                    keys.append(None)
                    bits.append(None)
                    continue
                low = minima(own, mul, add)
                keys.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(low.reshape(bands, ROWS))])
                kept = (low & np.uint64((1 << BITS) - 1)).astype(np.uint8)
                bits.append(np.packbits(np.unpackbits(kept[:, None], axis=1)[:, 8 - BITS :]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "content", "bands", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(made, "doc_id long, n_shingles long, content binary, bands array<long>, bits binary")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """id, content and own, the sorted shingle hashes, of each row of docs (doc_id, text); empty without words or text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in _slices(batches):
            split = [_folded(t) for t in b.column(1).to_pylist()]
            own = [shingles(words, size, hashes).view(np.int64) for words in split]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = np.concatenate([*own, np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_content(w) for w in split], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "content", "own"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(made, "id long, content binary, own array<long>")


def _least_agreeing(functions: int, percent: int) -> float:
    """How many of the packed minima two sets at the threshold agree in at least, but for six deviations.

    Bits of two minima agree by chance once in 2**BITS, so the similarity's estimate is (share - c) / (1 - c) with
    c = 2**-BITS, and at the threshold the share is this one.
    """
    s, c = percent / 100, 0.5**BITS
    share = s + (1 - s) * c
    return functions * share - 6 * math.sqrt(functions * share * (1 - share))


#: For each byte of two signatures' difference: how many minima in it differ.
_DIFFERING = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, -1, BITS).any(axis=2).sum(axis=1).astype(np.uint8)


def _agreeing(pairs: DataFrame, functions: int, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose packed low bits don't rule it out (see _least_agreeing)."""
    least = _least_agreeing(functions, percent)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in ("bits_u", "bits_v"))
            differ = _DIFFERING[x ^ y].sum(axis=1, dtype=np.int64)
            yield b.filter(pa.array(functions - differ >= least)).select(["u", "v"])

    fits = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    return pairs.where(fits).select("u", "v", "bits_u", "bits_v").mapInArrow(kept, "u long, v long")


def _linked(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold."""
    both = pairs.join(own.select(F.col("id").alias("u"), F.col("own").alias("own_u")), "u").join(own.select(F.col("id").alias("v"), F.col("own").alias("own_v")), "v")
    common = F.size(F.array_intersect("own_u", "own_v"))
    return both.withColumn("n", common).where(100 * F.col("n") >= percent * (F.size("own_u") + F.size("own_v") - F.col("n"))).select("u", "v")


def _meeting(rows: DataFrame, own: DataFrame, functions: int, percent: int, most: int = 200_000) -> DataFrame:
    """Links (u, v) between components within large buckets; rows has band, key, id, component, bits and total, the bucket's shingles.

    A bucket's members are dealt to blocks of about `most` shingles, and each pair of blocks is compared in a task of
    its own: first the packed bits of all pairs across components, then the full sets of those that may be similar.
    Only links that join two components leave it: fewer than its members.
    """
    blocks, least = F.ceil(F.col("total") / most).cast("int"), _least_agreeing(functions, percent)
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", "key", "id", "component", "bits", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compared(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, component, mine = (t.column(c).to_numpy() for c in ("id", "component", "mine"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        lists = t.column("own").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy()
        begin, low, high = np.cumsum(sizes) - sizes, t.column("i")[0].as_py(), t.column("j")[0].as_py()
        kinds, terms = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        has = np.zeros(len(kinds), dtype=bool)
        right = np.flatnonzero(mine == high)
        _, named = np.unique(component, return_inverse=True)
        root = np.arange(int(named.max()) + 1)  # of each component, always its last one's number
        out: list[tuple[int, int]] = []
        for x in np.flatnonzero(mine == low):
            if len(out) == len(root) - 1:
                break
            apart = right[root[named[right]] != root[named[x]]]
            apart = apart[100 * np.minimum(sizes[apart], sizes[x]) >= percent * np.maximum(sizes[apart], sizes[x])]
            apart = apart[bits.shape[1] and functions - _DIFFERING[bits[apart] ^ bits[x]].sum(axis=1, dtype=np.int64) >= least]
            if not len(apart):
                continue
            has[terms[begin[x] : begin[x] + sizes[x]]] = True
            for some in np.array_split(apart, 1 + int(sizes[apart].sum()) // most):
                ends = np.cumsum(sizes[some])
                at = np.repeat(begin[some] - (ends - sizes[some]), sizes[some]) + np.arange(ends[-1])
                common = np.add.reduceat(has[terms[at]].astype(np.int64), ends - sizes[some])
                for y in some[100 * common >= percent * (sizes[x] + sizes[some] - common)]:
                    p, q = int(root[named[x]]), int(root[named[y]])
                    if p != q:
                        root[root == p] = q
                        out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            has[terms[begin[x] : begin[x] + sizes[x]]] = False
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return dealt.join(own, "id").groupBy("band", "key", "i", "j").applyInArrow(compared, "u long, v long")


def _classed(docs: DataFrame, size: int, percent: int, rounds: int, few: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches; (content, c) for classes with copies or links, c being the smallest doc_id of their component; and
    (doc_id, shown) for doc_ids with several texts, shown being the content that counts."""
    bands = bands_for(percent / 100)
    sketch = stored(sketches(docs, size, bands))
    named = sketch.where("content IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("content").alias("content"), F.max("content").alias("other"))
    mixed = cut(named.where("content < other").select("doc_id", F.col("content").alias("shown")))
    classes = named.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    reps = sketch.join(classes.select(F.col("rep").alias("doc_id"), F.col("content").alias("c")), "doc_id").where("content = c").dropDuplicates(["doc_id"])
    met = reps.select(F.col("doc_id").alias("id"), "n_shingles", "bits", F.posexplode("bands").alias("band", "key"))
    crowded = met.groupBy("band", "key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("band", "key")
    met = stored(met.join(crowded, ["band", "key"]))
    ids = cut(met.select(F.col("id").alias("doc_id")).distinct())
    own = stored(sets(sized_join(docs.where("text IS NOT NULL").select("doc_id", "text"), ids, "doc_id", "left_semi"), size).groupBy("id").agg(F.min_by("own", "content").alias("own")))
    tested = links = None
    label = ids.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"))
    for k in range(rounds + 1):
        at = met.join(label, "id")
        bounds = at.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min(F.struct((F.xxhash64("id", F.lit(k)) if k else F.col("id")).alias("turn"), "id", "n_shingles", "bits", "component")).alias("lead")).where("low < high")
        if k < rounds:
            pairs = at.join(bounds.select("band", "key", "lead"), ["band", "key"]).where("component <> lead.component").select(
                F.least("id", "lead.id").alias("u"), F.greatest("id", "lead.id").alias("v"), F.col("n_shingles").alias("n_u"), F.col("lead.n_shingles").alias("n_v"), F.col("bits").alias("bits_u"), F.col("lead.bits").alias("bits_v"))
        else:
            left = at.join(bounds.select("band", "key", "n", "total"), ["band", "key"])
            rest = left.where(F.col("n") <= few)
            side = lambda x: rest.select("band", "key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "bits")), F.col("n_shingles").alias(f"n_{x}"))  # noqa: B023, E731
            pairs = side("u").join(side("v"), ["band", "key"]).where("id_u < id_v AND component_u <> component_v").select(
                F.col("id_u").alias("u"), F.col("id_v").alias("v"), "n_u", "n_v", "bits_u", "bits_v")
        pairs = pairs.dropDuplicates(["u", "v"])
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        new = stored(_agreeing(pairs, bands * ROWS, percent))
        tested = new if tested is None else tested.union(new)
        found = cut(_linked(new, own, percent))
        links = found if links is None else links.union(found)
        if k == rounds:
            links = links.union(cut(_meeting(left.where(F.col("n") > few), own, bands * ROWS, percent)))
        joined = components(links)
        label = cut(ids.join(joined, F.col("doc_id") == F.col("id"), "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "doc_id").alias("component")))
    of_class = classes.join(label, F.col("rep") == F.col("id"), "left").where("members > 1 OR component < rep").select("content", F.coalesce("component", "rep").alias("c"))
    return sketch, stored(of_class), mixed


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = 2, few: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Texts with the same words (A-Z in lower case) are one class, shown by its smallest doc_id; only classes are
    compared. Two are linked if 100 * common >= percent * union of their sets of `size`-word shingles, and meet as
    candidates if a band of minima agrees (a pair at the threshold escapes all bands once in a million).

    Within a band's bucket, links are sought until nothing more can join: each round pairs every class with one leader
    (another each round), verifies, and joins components; buckets that lie in one component by then are done. In what
    is left, buckets of up to `few` classes send out their pairs across components; larger ones are compared inside
    tasks, block by block, and only links that join components leave those. Every pair is judged by its packed bits
    before its full sets are read. So no bucket sends out the square of its
    size, and no link that would join two components is lost: there is no cap.

    Rows without words (or a null text) have no shingles and link with nothing; rows with a null doc_id are kept
    unlinked, with a null component_id. Rows of one doc_id count as one document: if their texts differ, the one with
    the smallest digest of its words is compared, and all of them get its component; each keeps its own n_shingles.
    Ties go to the smallest id. An empty table gives no rows, and other columns are ignored.
    """
    with many_executions(docs.sparkSession):
        sketch, of_class, mixed = _classed(carried(docs, ["doc_id", "text"], keep=[])[0], size, percent, rounds, few)
    rows = sized_join(sketch.select("doc_id", "n_shingles", "content"), mixed, "doc_id", "left").withColumn("content", F.when(F.col("content").isNotNull(), F.coalesce("shown", "content")))
    out = rows.join(of_class, "content", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
