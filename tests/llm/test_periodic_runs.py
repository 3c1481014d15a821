"""Runs of words against a plain scan of all periods, and the edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from mnemospark.llm import periodic_runs as P
from mnemospark.llm import queries

SHA = lambda b: hashlib.sha256(b).hexdigest()
SHAPE = "doc_id long, text string, N_Runs string, start string, _n_runs string"


def by_hand(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


def row(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_hand(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in found)]
    best = max(found, key=lambda x: ((x[1] - x[0]) / x[2], -x[0], -x[2]), default=None)
    head = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (doc_id, len(found), *head, SHA("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()), SHA(b" ".join(kept)))


def test_all_runs_of_random_words():
    r = random.Random(7)
    for _ in range(400):
        docs = []
        for _ in range(r.randint(1, 4)):
            w = []
            for _ in range(r.randint(0, 5)):
                base = [r.randint(1, r.choice([1, 2, 3, 40])) for _ in range(r.randint(1, 25))]
                w += (base * 9)[: r.randint(1, 150)] + [r.randint(1, 9) for _ in range(r.randint(0, 6))]
            docs.append(w)
        word, sizes = np.array([x for w in docs for x in w], dtype=np.int32), np.array([len(w) for w in docs])
        begin, end = P.segments(word, np.repeat(np.arange(len(docs)), sizes), P.least_overlap(4, 6))
        off = np.cumsum(sizes) - sizes
        assert P.smallest(P.runs(word, begin, end)) == [(s + o, e + o, q) for w, o in zip(docs, off.tolist(), strict=True) for s, e, q in by_hand(w)]


def test_other_bounds_and_too_few_periods():
    assert P.least_overlap(4, 6) == 5
    w = np.array([1] * 9 + [2, 3] * 5 + [4, 5, 6] * 4, dtype=np.int32)
    begin, end = P.segments(w, np.zeros(len(w), np.int64), P.least_overlap(5, 10))
    assert P.smallest(P.runs(w, begin, end, 5, 10)) == [(9, 19, 2)]
    with pytest.raises(ValueError):
        P.least_overlap(3, 6)


def test_a_long_run_is_found_in_near_linear_work():
    w = np.array([i % 1000 for i in range(400_000)] + [7] * 400_000, dtype=np.int32)
    begin, end = P.segments(w, np.zeros(len(w), np.int64), 5)
    assert P.smallest(P.runs(w, begin, end)) == [(0, 400_000, 1000), (400_000, 800_000, 1)]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, "b " * 7), (None, None), (5, "a\x1cb " * 12), (6, "x y " * 4 + "z " + "x y " * 4), (6, "x y " * 4 + "z " + "x y " * 4)]
    rows += [(i, " ".join(f"w{j % (i % 7 + 20)}" for j in range(50 * (i % 5)))) for i in range(100, 160)]
    df = spark.createDataFrame([(i, t, "n", "s", "_") for i, t in rows], SHAPE)
    got = P.periodic_runs(df)
    assert set(got.columns) == {"doc_id", "text", "_n_runs", *P.NEW}
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", *P.NEW).collect()))) == sorted(repr(row(i, t)) for i, t in rows)
    assert P.periodic_runs(df.limit(0)).collect() == []


def test_query_on_the_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, data).collect())
    assert got == sorted((row(i, t) for i, t in docs), key=lambda x: x[0]) and sum(r[1] > 0 for r in got) > 10
