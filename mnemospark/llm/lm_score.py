"""Language-model scores: stupid backoff over n-gram counts of the whole corpus, joined back to each document's n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried
from .minhash import WordHashes

BLOCK_BYTES = 6_000_000
PART_BYTES = 8_000_000  # of texts for each count table: tables grow in number with the corpus, not in size
BITS = 56  # of an n-gram's hash; a byte less is a sixth less to shuffle, and 10^12 n-grams still share a hash once in 70,000
TOTAL = np.uint64(0x58F42D4C957F2D)  # stands for the number of all words in the count tables


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - BITS)


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, pressed: high planes of small numbers cost nothing."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _freed(data: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list[bytes]]]:
    """(key, doc_ids, texts) of blocks of about BLOCK_BYTES; the same rows give the same blocks each time."""
    task, n = TaskContext.get().partitionId(), 0
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), [t or b"" for t in b.column("text").to_pylist()]
        ends, begin = np.cumsum([len(t) for t in texts]), 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK_BYTES, side="right")))
            digest = xxhash.xxh3_128()
            for t in texts[begin:end]:
                digest.update(len(t).to_bytes(8, "little") + t)
            yield f"{task}-{n}-{digest.hexdigest()}", ids[begin:end], texts[begin:end]
            begin, n = end, n + 1


def _grams(texts: list[bytes], order: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each text; each word's place in its text; for n from 1 to order, the hash of the n-gram that ends at each word."""
    split = [t.split() for t in texts]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter((hashes[w] for s in split for w in s), dtype=np.uint64, count=int(lengths.sum()))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = [_mixed(flat)]
    for n in range(1, order):
        longer = np.zeros(len(flat), dtype=np.uint64)
        longer[1:] = _mixed(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:] + np.uint64(n))
        grams.append(longer)
    return lengths, place, grams


def _all(place: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([g[place >= n] for n, g in enumerate(grams)])


def lm_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, parts: int | None = None) -> DataFrame:
    """doc_id, n_words and lm_score of every whole text of docs (doc_id, text).

    lm_score is the mean over the words of log10 S, where S of a word after its context is count(context + word) /
    count(context) for the longest n-gram up to `order` that other documents have, times `backoff` for each order
    given up; a single word has count / all words, and one that no other document has 1 / (all words + 1). Counts are
    of all documents less the one that is scored, else it would always be found.

    1. Each block of documents sends its distinct n-grams with their counts, by hash, to `parts` count tables (one for
       each PART_BYTES of texts, if not given).
    2. A table sums the counts of its n-grams over all blocks and answers each block, by position.
    3. A block's texts meet the answers; scores are summed per document.

    An n-gram counts once a block, so none is hot; only hashes, counts and packed texts are shuffled. Blocks must be
    the same in both readings of docs: read it from a table (their keys hold a digest; a changed block raises). Words
    are runs of characters other than ASCII white space, n-grams are told apart by hashes of BITS bits. Texts without words
    (or null) have n_words 0 and a null score; repeated rows are documents of their own; null doc_ids pass; an empty
    table gives no rows; other columns are ignored.
    """
    docs, _ = carried(docs, ["doc_id", "text"], keep=[])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if not parts:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    step = np.uint64((1 << BITS) // parts + 1)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for key, _, texts in _blocks(batches):
            lengths, place, grams = _grams(texts, order, hashes)
            seen, n = np.unique(_all(place, grams), return_counts=True)
            at = int(np.searchsorted(seen, TOTAL))
            seen, n = np.insert(seen, at, TOTAL), np.insert(n, at, lengths.sum())
            edges = np.searchsorted(seen, np.arange(parts, dtype=np.uint64) * step).tolist() + [len(seen)]
            there = [p for p in range(parts) if edges[p] < edges[p + 1]]
            deltas = [np.diff(seen[edges[p] : edges[p + 1]], prepend=np.uint64(0)) for p in there]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(there)), pa.array(there, pa.int32()), pa.array([_squeezed(d) for d in deltas], pa.binary()), pa.array([_squeezed(n[edges[p] : edges[p + 1]].astype("<u4")) for p in there], pa.binary())],
                names=["key", "part", "grams", "counts"],
            )

    def summed(rows: pa.Table) -> pa.Table:
        grams = [np.cumsum(_freed(g, "<u8"), dtype=np.uint64) for g in rows.column("grams").to_pylist()]
        counts = np.concatenate([_freed(c, "<u4") for c in rows.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(at, weights=counts).astype("<u8")[at]
        ends = np.cumsum([len(g) for g in grams])
        answers = [_squeezed(np.ascontiguousarray(x)) for x in np.split(total, ends[:-1])]
        return pa.table({"key": rows.column("key"), "part": rows.column("part"), "found": pa.array(answers, pa.binary()), "docs": pa.nulls(len(rows), pa.binary())})

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, texts in _blocks(batches):
            head = np.array([len(ids)] + [len(t) for t in texts], dtype="<i8").tobytes() + np.array([i is not None for i in ids], dtype=np.uint8).tobytes()
            raw = head + np.array([i or 0 for i in ids], dtype="<i8").tobytes() + b"".join(texts)
            packed = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names=["key", "part", "found", "docs"])

    def scored(block: pa.Table) -> pa.Table:
        rows = sorted(zip(block.column("part").to_pylist(), block.column("found").to_pylist(), block.column("docs").to_pylist(), strict=True), key=lambda r: r[0])
        if rows[0][0] != -1 or len(rows) < 2 or rows[1][0] == -1:
            raise RuntimeError("a block changed between two readings of the documents: store them as a table first")
        raw = pa.decompress(rows[0][2][8:], decompressed_size=int.from_bytes(rows[0][2][:8], "little"), codec="zstd", asbytes=True)
        n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
        sizes = np.frombuffer(raw, dtype="<i8", count=n, offset=8)
        there, ids = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8 * (n + 1)), np.frombuffer(raw, dtype="<i8", count=n, offset=8 * (n + 1) + n)
        ends = 8 * (n + 1) + 9 * n + np.concatenate([[0], np.cumsum(sizes)])
        texts = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        found = np.concatenate([_freed(f, "<u8") for _, f, _ in rows[1:]]).astype(np.int64)
        lengths, place, grams = _grams(texts, order, WordHashes())
        flat = _all(place, grams)
        seen, index = np.unique(flat, return_inverse=True)
        at = int(np.searchsorted(seen, TOTAL))
        words, found = int(found[at]), np.delete(found, at)
        doc = np.repeat(np.arange(n), lengths)
        others, begin = [], 0
        for k, g in enumerate(grams):
            own = np.flatnonzero(place >= k)
            i, begin = index[begin : begin + len(own)], begin + len(own)
            more = found[i] > 1  # what is counted once is this document's alone
            own, i = own[more], i[more]
            _, again, times = np.unique(doc[own] * len(seen) + i, return_inverse=True, return_counts=True)
            left = np.zeros(len(g), dtype=np.int64)
            left[own] = found[i] - times[again]
            others.append(left)
        rest = (words - lengths)[doc]
        score = np.where(others[0] > 0, others[0] / np.maximum(rest, 1), 1 / (rest + 1))
        for k in range(1, order):
            context = np.concatenate([[0], others[k - 1][:-1]])
            longer = np.where(others[k] > 0, others[k] / np.maximum(context, 1), backoff * score)
            score = np.where(place >= k, longer, score)
        sums = np.bincount(doc, weights=np.log10(score), minlength=n) if len(doc) else np.zeros(n)
        has = lengths > 0
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=there == 0), "n_words": pa.array(lengths), "lm_score": pa.array(sums / np.maximum(lengths, 1), pa.float64(), mask=~has)})

    # as many partitions as tables, and as many again for the blocks: what a task reads stays the same at any size
    tables = docs.mapInArrow(asked, "key string, part int, grams binary, counts binary").repartition(parts, "part").groupBy("part").applyInArrow(summed, "key string, part int, found binary, docs binary")
    return docs.mapInArrow(shipped, "key string, part int, found binary, docs binary").unionByName(tables).repartition(parts, "key").groupBy("key").applyInArrow(scored, "doc_id long, n_words long, lm_score double")
