"""Learned decision lists over document statistics, in DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, many_executions
from .stats import FEATURES, labelled, with_stats

#: A conjunction: (feature, "<=" or ">", threshold) and so on. A list of them is tried in order; the first that holds rejects.
Rule = tuple[tuple[str, str, float], ...]


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f) <= t if op == "<=" else F.col(f) > t for f, op, t in rule), F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, bins: int = 40, most_rules: int = 8, most_tests: int = 3, purity: float = 0.9) -> list[Rule]:
    """Rules that hold for documents labelled 0, by sequential covering.

    Two thirds of at most fit_rows labelled documents grow the rules and a third prunes them (a documented bound; the
    rest of the engine covers all rows). A rule grows by the threshold test of the largest FOIL gain, from one
    aggregate over all candidate tests, until it is pure or has most_tests tests. Pruning drops the last tests while
    (p - n) / (p + n) on the pruning rows doesn't fall. A rule stays if at least `purity` of what it rejects there is
    labelled 0; then its rows leave and the next rule grows. Covering ends when no rule stays, or at
    most_rules: a list of at most that many rules of at most most_tests tests is what is fitted, so that it can be read.
    No labelled rows: no rules, so every document is kept.
    """
    at = with_stats(labelled(carried(docs, ["doc_id", "text"], keep=[])[0], labels, fit_rows)).select("doc_id", "_y", "_s.*")
    rows = cut(at.withColumn("_grow", F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) > 0))
    cuts = rows.agg(*(F.percentile_approx(f, [i / bins for i in range(bins + 1)], 10_000).alias(f) for f in FEATURES)).first()
    if not cuts[FEATURES[0]]:
        return []
    cuts = {f: [(a + b) / 2 for a, b in pairwise(sorted(set(cuts[f] or [])))] for f in FEATURES}
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.where(~reduce(lambda a, b: a | b, map(_holds, rules), F.lit(False)))
        rule = _grown(left.where("_grow"), cuts, most_tests)
        rule = rule and _pruned(left.where("NOT _grow"), rule, purity)
        if not rule:
            break
        rules.append(rule)
    return rules


def _counted(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, str, float], tuple[int, int]]:
    """For each threshold test: rows labelled 0 and 1 for which it holds. A row counts once in one bin of each feature."""
    if not any(cuts.values()):
        return {}
    place = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: F.col(f) > c))
    at = F.array(*(F.struct(F.lit(f).alias("f"), place(f).alias("b")) for f in FEATURES if cuts[f]))
    found = rows.select("_y", F.inline(at)).groupBy("f", "b").agg(F.count_if(F.col("_y") == 0).alias("p"), F.count_if(F.col("_y") == 1).alias("n")).collect()
    out = {}
    for f in FEATURES:
        own = {r["b"]: (r["p"], r["n"]) for r in found if r["f"] == f}
        p, n = (sum(x[i] for x in own.values()) for i in (0, 1))
        under = [0, 0]
        for b, t in enumerate(cuts[f]):
            under = [u + x for u, x in zip(under, own.get(b, (0, 0)), strict=True)]
            out[f, "<=", t], out[f, ">", t] = tuple(under), (p - under[0], n - under[1])
    return out


def _grown(rows: DataFrame, cuts: dict[str, list[float]], most_tests: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most_tests:
        counts = _counted(rows.where(_holds(rule)), cuts)
        if not counts:
            break
        f, _, t = next(iter(counts))
        p, n = (counts[f, "<=", t][y] + counts[f, ">", t][y] for y in (0, 1))
        if p == 0 or n == 0:
            break
        gain = lambda t: counts[t][0] * (math.log2(counts[t][0] / sum(counts[t])) - math.log2(p / (p + n))) if counts[t][0] else 0.0  # noqa: B023, E731
        best = max(counts, key=gain)
        if gain(best) <= 1e-9:
            break
        rule += (best,)
    return rule


def _pruned(rows: DataFrame, rule: Rule, purity: float) -> Rule:
    ways = [rule[:k] for k in range(len(rule), 0, -1)]
    seen = rows.agg(*(F.count_if(_holds(w) & (F.col("_y") == y)).alias(f"w{i}_{y}") for i, w in enumerate(ways) for y in (0, 1))).first()
    worth = lambda i: (seen[f"w{i}_0"] - seen[f"w{i}_1"]) / max(1, seen[f"w{i}_0"] + seen[f"w{i}_1"])
    best = max(range(len(ways)), key=lambda i: (worth(i), i))
    p, n = seen[f"w{best}_0"], seen[f"w{best}_1"]
    return ways[best] if p >= 2 and p >= purity * (p + n) else ()


def rule_column(rules: list[Rule]) -> Column:
    """The ordered conditional: the number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_holds(rule), F.lit(i)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, train: DataFrame | None = None) -> DataFrame:
    """docs with its statistics, base_failed, rule (the number that rejected it, 0 for none) and kept.

    The rules are learned from the labelled documents of `train`, docs itself if none is given. Needs columns doc_id
    and text; others pass, and columns of the result's names, in any case, are replaced. A null text counts as empty and
    fails the base test. Repeated rows and ties are judged row by row; an empty table gives no rows.
    """
    with many_executions(docs.sparkSession):
        rules = learn(docs if train is None else train, labels, fit_rows)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df, back = carried(docs, ["text"], [*new, "base_failed", "kept", "rule"])
    df = with_stats(df)
    failed = (F.col("_s.n_words") < 50) | (100 * F.col("_s.n_repeat_words") > 50 * F.col("_s.n_words"))
    df = df.select(*(c for c in df.columns if c != "_s"), "_s", failed.alias("_failed"), *(F.col("_s")[f].alias(f) for f in FEATURES)).withColumn("_rule", rule_column(rules))
    return df.select(*back, *(F.col("_s")[c].alias(c) for c in new), F.col("_failed").alias("base_failed"), (~F.col("_failed") & (F.col("_rule") == 0)).alias("kept"), F.col("_rule").alias("rule"))
