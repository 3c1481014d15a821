"""The growing registry against a loop by hand, and exact search in cells against all products."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from mnemospark.operators import registry as R
from mnemospark.operators import search as S
from mnemospark.operators import vectors as V

MENTION = "namespace string, place long, alias string, type string, v array<double>, extra string"
ENTITY = "namespace string, id string, type string, place long, aliases array<string>, v array<double>"


def unit(v):
    v = np.array(v, float)
    n = np.linalg.norm(v)
    return v / n if n else v


def by_hand(mentions, entities, high, low, spelt, conservative):
    """Each name once, then one after the other; ids of new entities are told by their first alias."""
    first = {}
    for ns, place, alias, kind, v, _ in sorted(mentions, key=lambda m: m[1]):
        alias = alias.strip()
        if not alias:
            continue
        k = (ns, alias.lower())
        if k not in first:
            first[k] = [place, alias, kind, v]
        elif R.PRECEDENCE[kind] > R.PRECEDENCE[first[k][2]]:
            first[k][1:] = [alias, kind, v]
    known = [dict(ns=ns, id=i, type=t, aliases=list(a), v=unit(v)) for ns, i, t, p, a, v in sorted(entities, key=lambda e: (e[3], e[1]))]
    out, asked = {}, set()
    for (ns, _), (_, alias, kind, v) in sorted(first.items(), key=lambda x: x[1][0]):
        own = [e for e in known if e["ns"] == ns and e["type"] == kind]
        exact = next((e for e in reversed(own) if alias.lower() in [a.lower() for a in e["aliases"]]), None)
        rest = [(-round(float(e["v"] @ unit(v)), 6), e["id"], e) for e in own if e is not exact]
        best = min(rest, key=lambda x: x[:2], default=None)
        alike = best and -best[0] >= high
        near = best and (alike or -best[0] >= low and max(SequenceMatcher(None, alias.lower(), a.lower()).ratio() for a in best[2]["aliases"]) >= spelt)
        if exact:
            if conservative and kind == "entity":
                asked.add((ns, alias, kind, "exact", exact["id"]))
                out[ns, alias] = (None, "unresolved")
            else:
                out[ns, alias] = (exact["id"], "exact")
            if near and (conservative or not alike):
                asked.add((ns, alias, kind, "merge", best[1]))
        elif alike and not conservative:
            best[2]["aliases"].append(alias)
            out[ns, alias] = (best[1], "alike")
        elif near:
            asked.add((ns, alias, kind, "alias", best[1]))
            out[ns, alias] = (f"new:{alias}", "new")
        else:
            known.append(dict(ns=ns, id=f"new:{alias}", type=kind, aliases=[alias], v=unit(v)))
            out[ns, alias] = (f"new:{alias}", "new")
    return out, asked


def tables(seed):
    r = random.Random(seed)
    bases = [[r.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    near = lambda b: [x + r.gauss(0, 0.25) for x in b]
    names = [f"{w}{i}" for w in ("anna", "berlin", "chair") for i in range(12)] + ["  Anna1 ", "BERLIN2", "", "e0"]
    mentions = [(f"n{r.randint(0, 1)}", p, r.choice(names), r.choice(["gpe", "entity", "object"]), near(r.choice(bases)), "x") for p in range(120)]
    entities = [(f"n{i % 2}", f"e{i}", ["gpe", "entity", "object"][i % 3], i, [f"e{i}", f"anna{i}"], near(bases[i])) for i in range(5)]
    return mentions, entities


@pytest.mark.parametrize("conservative", [True, False])
def test_folds_as_by_hand(spark, conservative):
    # what is alike merges entities in the plain loop only after all mentions; none of these tables has an exact name for that
    mentions, entities = tables(5)
    got, asked = R.grown(R.collected(spark.createDataFrame(mentions, MENTION)), spark.createDataFrame(entities, ENTITY), 0.95, 0.8, 0.8, conservative)
    want, questions = by_hand(mentions, entities, 0.95, 0.8, 0.8, conservative)
    named = {r.id: f"new:{r.alias}" for r in got.collect() if r.how == "new"}
    rows = {(r.namespace, r.alias): (named.get(r.id, r.id), r.how) for r in got.collect()}
    if conservative:
        assert rows == want
        assert {(r.namespace, r.alias, r.type, r.kind, named.get(r.id, r.id)) for r in asked.collect()} == questions and questions
    else:
        assert {k: how for k, (_, how) in rows.items()} == {k: how for k, (_, how) in want.items()}
        assert {"alike", "new"} <= {how for _, how in rows.values()}


def test_order_decides(spark):
    """a and c are both like b, but not alike: who comes first decides whom b means, and two new names become one entity."""
    angle = {"a": 0.0, "b": 0.4, "c": 0.8}
    entity = spark.createDataFrame([], ENTITY)
    for order, ids in (("abc", 2), ("bac", 1), ("cba", 2)):
        rows = [("n", i, x, "entity", [float(np.cos(angle[x])), float(np.sin(angle[x]))], "") for i, x in enumerate(order)]
        got, _ = R.grown(R.collected(spark.createDataFrame(rows, MENTION)), entity, 0.9, 0.9, 1.1, conservative=False)
        own = {r.alias: r.id for r in got.collect()}
        assert len(set(own.values())) == ids and own[order[0]] == own[order[1]]


def test_verdicts_merge_and_resolve(spark):
    entities = [("n", "e1", "entity", 1, ["ann"], [1.0, 0.0]), ("n", "e2", "entity", 2, ["anna"], [0.99, 0.1])]
    mentions = [("n", 1, "Ann", "entity", [1.0, 0.0], ""), ("n", 2, "annie", "entity", [0.98, 0.12], ""), ("n", 3, "zoe", "entity", [0.0, 1.0], ""), ("n", 4, "zo", "entity", None, "")]
    said = spark.createDataFrame([("n", "Ann", "entity", "merge", True), ("n", "Ann", "entity", "exact", True), ("n", "annie", "entity", "alias", True)], "namespace string, alias string, type string, kind string, same boolean")
    got, _ = R.grown(R.collected(spark.createDataFrame(mentions, MENTION)), spark.createDataFrame(entities, ENTITY), verdicts=said)
    own = {r.alias: (r.id, r.how) for r in got.collect()}
    assert own["Ann"] == ("e1", "judged") and own["annie"] == ("e1", "judged") and own["zoe"][1] == own["zo"][1] == "new" and own["zoe"][0] != own["zo"][0]


def test_cells_find_what_all_products_find(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 16))
    x = centres[rng.integers(0, 50, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    x[:5], x[5:30] = 0, x[5]
    frame = lambda m, names: spark.createDataFrame([(i, None if v is None else [float(y) for y in v]) for i, v in enumerate(m)], names)
    rows = frame([*x, None], "id long, v array<double>")
    probes = frame([*x[[0, 5, 40, 41]], *rng.normal(size=(8, 16)), None], "probe long, pv array<double>")
    found, share = V.topk(probes, V.celled(rows), 7)
    every, _ = V.topk(probes, V.celled(rows, cells=1), 7)
    got = sorted(map(tuple, found.select("probe", "id", "score", "rank").collect()))
    assert got == sorted(map(tuple, every.select("probe", "id", "score", "rank").collect())) and share < 0.7
    plain = S.dense(probes.where("pv IS NOT NULL"), rows.where("v IS NOT NULL"), 7).select("probe", "id", "score", "rank")
    some = {p: [(i, s, k) for q, i, s, k in got if q == p] for p in range(1, 12)}
    for p, i, s, k in plain.collect():
        if p in some:
            assert (i, pytest.approx(s, abs=1e-6), k) in some[p]
    assert V.topk(probes, V.celled(rows.limit(0)), 3)[0].collect() == []
