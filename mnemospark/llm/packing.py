"""Packing documents' ids into sequences: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Words
from .common import carried, stored

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Capacities:
    """Open sequences by remaining capacity, 0 to `size`; a segment tree over them finds the tightest that holds a piece."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree, self.open = [0] * (2 * self.width), [[] for _ in range(size + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.width
        while i:
            self.tree[i] += n
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the smallest capacity of at least `least`; that sequence leaves. None: there is none."""
        tree, i = self.tree, least + self.width
        while not tree[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.width
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, which must not increase; sequences count from 0."""
    capacities, out, n = Capacities(size), [], 0
    for length in lengths:
        if length == size:
            out.append((n, 0))
            n += 1
            continue
        if found := capacities.take(length):
            capacity, sequence = found
        else:
            capacity, sequence, n = size, n, n + 1
        out.append((sequence, size - capacity))
        if capacity > length:
            capacities.put(capacity - length, sequence)
    return out


def cut_pieces(docs: DataFrame, name: str = "word_bpe_49k.json", size: int = 2048, end: int = 1) -> DataFrame:
    """Documents' ids, each ended by id `end`, cut into windows of `size` ids and a rest: one row a piece.

    docs has doc_id and text; other columns are ignored. A null or empty text is `end` alone; null doc_ids and repeated
    rows are cut like others; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = Words.shared(name), np.array([end], dtype="<u4")
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, encoded in zip(b.column(0).to_pylist(), words.ids(b.column(1)), strict=True):
                ids = np.concatenate([encoded, last])
                for start in range(0, len(ids), size):
                    own = ids[start : start + size]
                    for column, v in zip(out, (doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        words.trim()

    docs, _ = carried(docs, ["doc_id", "text"], keep=[])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", size: int = 2048, group: int = 200_000) -> DataFrame:
    """One row a piece of every document of docs (doc_id, text), with sequence_id and offset in its sequence.

    Pieces are dealt round robin to tasks of about `group` pieces; each packs its own from the longest down, which
    costs a few open sequences a task. No key decides where a piece goes, so none is hot. A null or empty text has
    the end id alone. Repeated rows and null doc_ids are packed like others; an empty table gives no rows.
    """
    pieces = stored(cut_pieces(docs, name, size))
    tasks = max(1, -(-pieces.count() // group))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        places, first = best_fit(rows.column("length").to_pylist(), size), TaskContext.get().partitionId() << 32
        rows = rows.append_column("sequence_id", pa.array([first + s for s, _ in places], pa.int64())).append_column("offset", pa.array([o for _, o in places], pa.int64()))
        yield from rows.to_batches()

    return pieces.repartition(tasks).mapInArrow(packed, PIECE + ", sequence_id long, offset long")
