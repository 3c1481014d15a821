"""Periodic runs of words in every document: a mask of repeated k-grams, then Main-Lorentz on what it leaves."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, release

#: Texts are looked at together up to so many bytes; a longer one by itself.
BLOCK_BYTES = 4_000_000
NEW = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words, by the contract's rule; None if nothing moves."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def least_overlap(times: int, least: int) -> int:
    """The k of the mask, from what a run shares with itself moved by its period q, all but q words: with q - 1 words
    less, every k-gram of a run has its equal a period earlier or later inside the run."""
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found")
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, max(least, 1) + 1))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segments(word: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches whose k-grams all occur twice or more in their part; `part` ascends.

    A run has each of its k-grams twice inside itself (`least_overlap`). So the mask is laid again on what it left, with
    the stretches as parts, until it takes nothing more away or four times.
    """
    n = len(word)
    if n <= k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = word[: n - k + 1].astype(np.uint64)
    for i in range(1, k):
        gram = _mixed(gram, word[i : n - k + 1 + i].astype(np.uint64))
    at = np.flatnonzero(part[: n - k + 1] == part[k - 1 :])
    own = part[at]
    for _ in range(4):
        key = _mixed(gram[at], own.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        left, own = at[twice], own[twice]
        if not len(left):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate([[True], (np.diff(left) > 1) | (np.diff(own) > 0)])
        begin, size = left[new], np.diff(np.append(np.flatnonzero(new), len(left)))
        wide = size > 1  # a run has two k-grams or more
        done, at = len(left) == len(at) and wide.all(), left[np.repeat(wide, size)]
        own = np.repeat(np.arange(int(wide.sum())), size[wide])
        if done or not len(at):
            break
    return begin[wide], begin[wide] + size[wide] - 1 + k


def _same_for(word: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """For how many places from a and b on, in the direction of step, the words are the same; at most `most`."""
    done, width = 0, 64
    while done < most:
        width = min(width, most - done)
        x, y = (word[i + done : i + done + width] if step > 0 else word[i - done - width + 1 : i - done + 1][::-1] for i in (a, b))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, width = done + width, 2 * width
    return most


def runs(word: np.ndarray, begin: np.ndarray, end: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all maximal runs inside the segments, at least max(least, times * period) words long.

    Main-Lorentz: a segment is halved again and again, and around every middle m each period p is tried: how far do
    the words from m on agree with those p later, and the words before m with those p later? Here the halves are
    visited by level. At level j the middles are the multiples of 2^(j+1), the periods those from 2^j to 2^(j+1) - 1: a
    run of four periods or more covers such a middle and two more periods after it. So a middle and a period are
    looked at closer only if the two periods after the middle are equal, told by hashes of 2^j words (doubled from
    level to level). The extensions compare words, so no run rests on hashes alone; a middle whose two periods lie
    in a run of a smaller period has that run's period only and is passed over.
    """
    found: list[tuple[int, int, int]] = []
    half = 1
    hashed, lo, hi = word.astype(np.uint64) + np.uint64(1), begin, end
    flat = np.zeros(0, np.int64)
    while True:
        wide = hi - lo >= max(least, times * half)
        if not wide.any():
            return found
        if half == 1 or not wide.all():
            # only segments that hold such a run, side by side; hashes past a segment's end differ from all others
            sizes = (hi - lo)[wide]
            stop = np.cumsum(sizes)
            pick = np.repeat(lo[wide] - (stop - sizes), sizes) + np.arange(stop[-1])
            hashed, flat = hashed[pick], pick if half == 1 else flat[pick]
            # places in the words, and the segments' bounds there and here
            lo, hi = stop - sizes, stop
        n = len(hashed)
        reach = _reach(found, flat)
        rows = n // (2 * half)
        grid = hashed[: rows * 2 * half].reshape(rows, 2 * half)
        for first in range(0, rows, max(1, 1_000_000 // half)):
            block = grid[first : first + max(1, 1_000_000 // half)]
            r, c = np.nonzero(block[:, half:] == block[:, :1])
            if not len(r):
                continue
            m, p = (r + first) * 2 * half, c + half
            # the two periods after the middle are equal, in one segment, and lie in no run found at a level below
            ok = m + 2 * p <= n
            m, p = m[ok], p[ok]
            seg = np.searchsorted(hi, m, side="right")
            ok = (m + 2 * p <= hi[seg]) & (hashed[m + p - half] == hashed[m + 2 * p - half]) & (reach[m] < m + 2 * p)
            m, p, seg = m[ok], p[ok], seg[ok]
            order = np.lexsort((m, p))
            last = (-1, -1, 0)
            for i in order.tolist():
                at, q, s = int(m[i]), int(p[i]), int(seg[i])
                if last[2] == q and last[0] <= at and at + q <= last[1]:
                    continue
                base = int(flat[at])
                low, high = base - (at - int(lo[s])), base + int(hi[s]) - at
                fore = _same_for(word, base, base + q, 1, high - base - q)
                back = _same_for(word, base - 1, base + q - 1, -1, base - low)
                last = (at - back, at + q + fore, q)
                if fore + back + q >= max(least, times * q):
                    found.append((base - back, base + q + fore, q))
        # hashes of twice as many words; none reaches past its segment
        if half == 1 << 40:
            return found
        longer = np.empty_like(hashed)
        longer[: n - half] = _mixed(hashed[: n - half], hashed[half:])
        longer[n - half :] = np.arange(half, dtype=np.uint64)
        hashed, half = longer, 2 * half


def _reach(found: list[tuple[int, int, int]], flat: np.ndarray) -> np.ndarray:
    """For each place of `flat` (places of the words, ascending): the place, counted here, up to which a run that began before or at it goes."""
    out = np.full(len(flat), -1, np.int64)
    if found:
        at = np.array(found, dtype=np.int64)
        s, e = np.searchsorted(flat, at[:, 0]), np.searchsorted(flat, at[:, 1] - 1, side="right")
        inside = s < len(flat)
        np.maximum.at(out, s[inside], e[inside])
        out = np.maximum.accumulate(out)
    return out


def smallest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One run for each stretch, with its smallest period; by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        if q < best.get((s, e), q + 1):
            best[s, e] = q
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def _longest(own: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the largest exact length / period; ties: the smallest start, then period. Own ones are in that order."""
    best = None
    for s, e, q in own:
        if best is None or (e - s) * best[2] > (best[1] - best[0]) * q:
            best = (s, e, q)
    return best


def analysed(ids: list[int | None], texts: list[bytes], times: int = 4, least: int = 6) -> Iterator[tuple]:
    """For each text the values of NEW."""
    split = [t.split() for t in texts]
    for d, w in enumerate(split):
        moved = planted(ids[d], len(w))
        if moved is not None:
            split[d] = [w[i] for i in moved.tolist()]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    ends = np.cumsum(sizes)
    by_doc: list[list[tuple[int, int, int]]] = [[] for _ in split]
    if len(ends) and ends[-1]:
        word = pa.array(list(chain.from_iterable(split)), pa.large_binary()).dictionary_encode().indices.to_numpy()
        begin, end = segments(word, np.repeat(np.arange(len(split)), sizes), least_overlap(times, least))
        for s, e, q in smallest(runs(word, begin, end, times, least)) if len(begin) else ():
            d = int(np.searchsorted(ends, s, side="right"))
            by_doc[d].append((s - int(ends[d] - sizes[d]), e - int(ends[d] - sizes[d]), q))
    for w, own in zip(split, by_doc, strict=True):
        best, kept = _longest(own), w
        if own:
            gone = np.zeros(len(w) + 1, np.int64)
            np.add.at(gone, [s + q for s, e, q in own], 1)
            np.add.at(gone, [e for s, e, q in own], -1)
            kept = [x for x, g in zip(w, np.cumsum(gone).tolist(), strict=False) if not g]
        told = "".join(f"{s},{e - s},{q}\n" for s, e, q in own)
        s, e, q = best or (None, None, None)
        yield (
            len(own), s, best and e - s, q, best and 1000 * (e - s) // q,
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
        )


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with n_runs, the run of the greatest exponent (start, length, period,
    exponent_milli), runs_sha256 and collapsed_sha256.

    Needs doc_id and text. Words are runs of characters other than ASCII white space; where the rule of `planted` holds,
    a document's words are those it makes. A null or empty text has no words and no run: four nulls, and the hashes of
    the empty string. A null doc_id moves no word. Ties for the greatest exponent go to the smallest start, then the
    smallest period. Every row is looked at by itself, so repeated rows give equal results; an empty table gives no
    rows. Columns of the result's names, in any case, are replaced, others pass. Nothing is shuffled; a task holds one
    block of texts, or one long text, at a time.
    """
    df, back = carried(docs, ["doc_id", "text"], NEW, keep)
    whole = "text" in {c.lower() for c in (docs.columns if keep is None else keep)}
    own = [c for c in df.columns if c != "text" or whole]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column("text"), "").cast(pa.binary())
            ends, i = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
                rows = list(analysed(b.column("doc_id").slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist(), times, least))
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in own), *new], names=[*own, *(f"_{c}" for c in NEW)])
                i = j
        release()

    new = [F.lit(None).cast("long" if t == pa.int64() else "string").alias(f"_{c}") for c, t in zip(NEW, kinds, strict=True)]
    schema = df.select(*own, *new).schema
    return df.mapInArrow(told, schema).select(*back, *(F.col(f"_{c}").alias(c) for c in NEW))
