"""What the rules' learner and the classifier's fit make of labelled documents, against plain versions over the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import quality_classifier as QC
from mnemospark.llm import quality_rules as QR
from mnemospark.llm import queries, stats
from mnemospark.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def rows(docs, labels, salt, parts):
    at = stats.with_stats(stats.labelled(docs.select("doc_id", "text"), labels, 12_000)).select("doc_id", "_y", "_s.*")
    return at.withColumn("own", F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(parts)) > 0).collect()


def quantiles(values, shares):
    """The smallest value that at least such a share of all doesn't exceed."""
    s = sorted(values)
    return [s[max(0, math.ceil(p * len(s)) - 1)] for p in shares]


def covered(data, bins=40, most_rules=8, most_tests=3, purity=0.9):
    """Sequential covering over plain tuples."""
    cuts = {}
    for f in stats.FEATURES:
        edges = sorted(set(quantiles([r[f] for r in data], [i / bins for i in range(bins + 1)])))
        cuts[f] = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    holds = lambda rule, r: all(r[f] <= t if op == "<=" else r[f] > t for f, op, t in rule)
    rules = []
    while len(rules) < most_rules:
        left = [r for r in data if not any(holds(q, r) for q in rules)]
        rule = ()
        while len(rule) < most_tests:
            own = [r for r in left if r["own"] and holds(rule, r)]
            p, n = sum(r["_y"] == 0 for r in own), sum(r["_y"] == 1 for r in own)
            if not p or not n:
                break
            best, most = None, 1e-9
            for f in stats.FEATURES:
                for t in cuts[f]:
                    for op in ("<=", ">"):
                        got = [r["_y"] for r in own if holds(((f, op, t),), r)]
                        zero = got.count(0)
                        gain = zero * (math.log2(zero / len(got)) - math.log2(p / (p + n))) if zero else 0.0
                        if gain > most + (1e-12 if best else 0):
                            best, most = (f, op, t), gain
            if best is None:
                break
            rule += (best,)
        if not rule:
            break
        told = []
        for k in range(len(rule), 0, -1):
            got = [r["_y"] for r in left if not r["own"] and holds(rule[:k], r)]
            told.append(((got.count(0) - got.count(1)) / max(1, len(got)), -k, got.count(0), len(got)))
        _, k, zero, of = max(told, key=lambda x: (x[0], x[1]))
        if zero < 2 or zero < purity * of:
            break
        rules.append(rule[:-k])
    return rules


def test_rules_equal_a_plain_learner(spark, tables):
    docs, labels = tables
    rules = QR.learn(docs, labels)
    assert rules and rules == covered(rows(docs, labels, "prune", 3))
    got = {r.doc_id: (r.rule, r.kept) for r in queries.op2_quality_rules(spark, SF).select("doc_id", "rule", "kept", "base_failed").collect()}
    for r in stats.with_stats(docs.select("doc_id", "text")).select("doc_id", "_s.*").collect():
        first = next((i for i, q in enumerate(rules, 1) if all(r[f] <= t if op == "<=" else r[f] > t for f, op, t in q)), 0)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert got[r.doc_id] == (first, not failed and not first)


def plain_scores(data, every, width=192, gamma=0.15, ridge=1e-3, bins=200):
    x, y, own = np.array([[r[f] for f in stats.FEATURES] for r in data]), np.array([r["_y"] for r in data]), np.array([r["own"] for r in data])
    if len(set(y)) < 2:
        return np.full(len(every), y.mean() if len(y) else 0.5)
    nine = lambda v: np.array([float(f"{a:.9g}") for a in v])
    centre, scale = nine(x.mean(axis=0)), nine(x.std(axis=0))
    scale[scale == 0] = 1
    rng = np.random.default_rng(7)
    way, shift = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], width)), rng.uniform(0, 2 * np.pi, width)
    phi = lambda z: np.column_stack([np.sqrt(2 / width) * np.cos(np.clip((z - centre) / scale, -6, 6) @ way + shift), np.ones(len(z))])
    fit, rest = own if len(set(y[own])) == 2 else np.full(len(y), True), ~own if len(set(y[~own])) == 2 else np.full(len(y), True)
    a = phi(x[fit])
    w = np.linalg.solve(a.T @ a + ridge * max(1.0, fit.sum()) / width * np.eye(width + 1), a.T @ y[fit])
    raw, told = phi(x[rest]) @ w, y[rest]
    edges = np.array(sorted(set(quantiles(raw, [i / bins for i in range(1, bins)]))))
    place = (raw[:, None] > edges).sum(axis=1)
    cells = sorted((raw[place == b].mean(), told[place == b].mean(), (place == b).sum()) for b in set(place))
    m, v, n = (np.array(c) for c in zip(*cells, strict=True))
    mean = lambda i, j: (v[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum()
    level = [max(min(mean(i, j) for j in range(k, len(v))) for i in range(k + 1)) for k in range(len(v))]
    return np.clip(np.interp(phi(np.array([[r[f] for f in stats.FEATURES] for r in every])) @ w, m, level), 0, 1)


@pytest.mark.parametrize("some", [None, 19, 5, 2, 0])
def test_scores_equal_a_plain_fit(spark, tables, some):
    docs, labels = tables
    learned = labels.where(~held_out(F.col("doc_id")))
    few = learned if some is None else learned.withColumn("n", F.expr("row_number() OVER (PARTITION BY quality ORDER BY doc_id)")).orderBy("n", "quality").limit(some).drop("n")
    every = stats.with_stats(docs.select("doc_id", "text")).select("doc_id", "_s.*").collect()
    want = dict(zip((r.doc_id for r in every), plain_scores(rows(docs, few, "calibrate", 5), every), strict=True))
    got = {r.doc_id: r.score for r in QC.quality_scores(docs, few, keep=["doc_id"]).collect()}
    assert max(abs(got[d] - want[d]) for d in want) < 1e-4
    assert (len(set(got.values())) > 1) == (some is None or some > 1)
