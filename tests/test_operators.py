"""Operators that need more than SQL to test: greedy choices, folds, windows, simulated people, dates."""

import datetime
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.operators import answers as A
from mnemospark.operators import evaluation as E
from mnemospark.operators import generator as GEN
from mnemospark.operators import graph as G
from mnemospark.operators import intents as I
from mnemospark.operators import memory as M
from mnemospark.operators import personas as P
from mnemospark.operators import runtime as R
from mnemospark.operators import search as S
from mnemospark.operators import selection as SEL
from mnemospark.operators import state as ST
from mnemospark.operators import temporal as T
from mnemospark.operators import texts as X
from mnemospark.operators import times as TIMES
from mnemospark.operators import windows as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_judged_fixture(spark):
    df = spark.createDataFrame([("dynamic_conflict", 1.0, 1, 1), ("dynamic_conflict", 0.5, 4, 0), ("static_conflict", 0.0, 2, 0), ("conditional_conflict", 1.0, 3, 1)], "conflict_type string, accuracy double, support_rank int, handling int")
    got = {r.conflict_type: r for r in E.metrics(df, [3]).collect()}
    assert (got["dynamic_conflict"].aa, got["dynamic_conflict"].seh) == (0.75, 0.5)
    assert (got["static_conflict"].aa, got["static_conflict"].seh) == (0.0, 1.0)
    assert got["conditional_conflict"].aa == 1.0 and got["conditional_conflict"].ch is None
    assert abs(E.macro(E.metrics(df, [3])).first().aa - (0.75 + 0 + 1) / 3) < 1e-12
    only = E.metrics(df.where("conflict_type = 'dynamic_conflict'"), [3])
    assert {r.conflict_type: r.aa for r in only.collect()} == {"dynamic_conflict": 0.75, "static_conflict": None, "conditional_conflict": None}
    assert E.macro(only).first().aa == 0.75


def test_coercions(spark):
    df = spark.createDataFrame([("0.8", False), ("0.5", False), ("0.5", True), ("0.2", False), ("x", False), (None, True)], "x string, strict boolean")
    assert [r[0] for r in df.select(C.half_steps(F.col("x"), F.col("strict"))).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]
    ranks = spark.createDataFrame([(0,), (1,), (3,), (4,)], "r int")
    assert [r[0] for r in ranks.select(C.rank_support(F.col("r"), 3)).collect()] == [0.0, 1.0, 0.5, 0.0]


def test_fold(spark):
    ops = [(1, 1, "add", "a", "x"), (1, 2, "add", "a", "x"), (1, 3, "replace", "a", "y"), (1, 4, "retract", "a", None), (1, 5, "replace", "a", "z"), (2, 1, "reinforce", "b", None), (2, 2, "add", "b", "q"), (2, 3, "nonsense", "b", "q")]
    df = spark.createDataFrame([(*o, 0.9) for o in ops], "chain long, seq long, op string, key string, value string, confidence double")
    for parts in (1, 7):
        got = rows(ST.fold(df.repartition(parts)).select("chain", "seq", "decision", "epoch", "closed_value", F.round("confidence", 3)), "chain", "seq")
        assert got == [
            (1, 1, "extend", 0, None, 0.9), (1, 2, "reinforce", 0, None, 0.95), (1, 3, "revise", 1, "x", 0.9), (1, 4, "revise", 2, "y", None), (1, 5, "rejected", 2, None, None),
            (2, 1, "rejected", -1, None, None), (2, 2, "extend", 0, None, 0.9), (2, 3, "rejected", 0, None, None),
        ]


def test_windows_hold_every_token(spark):
    turns = [(1, 0, "a " * 90), (1, 1, "b " * 90), (1, 2, "c " * 450), (1, 3, None), (2, 0, "d"), (2, 1, "")]
    got = rows(W.plan_windows(spark.createDataFrame(turns, "conv_id long, turn long, text string"), 120, 200), "conv_id", "turn", "part")
    assert sum(r[4] for r in got if r[0] == 1) == 630 and sum(r[4] for r in got if r[0] == 2) == 1
    sizes = {}
    for c, _, _, w, n in got:
        sizes[c, w] = sizes.get((c, w), 0) + n
    assert max(sizes.values()) <= 200 and [w for c, *_, w, _ in got if c == 1] == sorted(w for c, *_, w, _ in got if c == 1)


def test_diverse_and_covering(spark):
    v = [1.0, 0.0]
    c = spark.createDataFrame([(1, 1, 0.9, 0, 0, 1, v), (1, 2, 0.89, 0, 0, 1, v), (1, 3, 0.84, 1, 1, 1, [0.0, 1.0])], "probe long, id long, score double, topic int, kind int, importance int, v array<double>")
    assert [r.id for r in SEL.diverse(c, 2).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in SEL.deduplicated(c.select("probe", "id", "score", "v")).orderBy("rank").collect()] == [1, 3]
    n = spark.createDataFrame([(1, 1, 0.9, "a", False), (1, 2, 0.8, "a", False), (1, 3, 0.2, "b", False), (1, 4, 0.1, "a", True)], "probe long, id long, score double, need string, protected boolean")
    assert [r.id for r in SEL.covering(n, 3).orderBy("rank").collect()] == [1, 3, 4]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    ev = [(int(g), i, int(t)) for i, (g, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60), strict=True))]
    df = spark.createDataFrame(ev, "g long, id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    anchors = df.where("id % 3 = 0").select("g", F.col("id").alias("anchor"), F.col("ts").alias("at"))
    pool = df.where("id % 3 <> 0").select("g", "id", "ts")
    for side, test in (("before", lambda a, t: t <= a), ("after", lambda a, t: t > a), ("nearest", lambda a, t: True)):
        got = {}
        for r in T.neighbours(anchors, pool, ["g"], 2, side).orderBy("anchor", "rank").collect():
            got.setdefault(r.anchor, []).append(r.gap_us // 1_000_000)
        want = {i: sorted(abs(t - u) for h, j, u in ev if h == g and j % 3 and test(t, u))[:2] for g, i, t in ev if i % 3 == 0}
        assert got == {k: x for k, x in want.items() if x}


def test_relations_and_merge(spark):
    got = {r.id: r.canonical for r in G.merged(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
    base = {"action": "go", "start": 0, "entities": ["x"], "title": ["t"], "topic": "p", "session": 1, "chain": 1}
    cases = [({}, {}, "SAME_EVENT"), ({}, {"start": None}, "SAME_EVENT"), ({}, {"action": "eat"}, "SAME_EVENT"), ({}, {"action": "eat", "title": ["u"], "session": 2}, "FOLLOW_UP_OF"), ({}, {"action": "eat", "title": ["u"], "chain": 2, "topic": "q"}, "CONTEXT_FOR"), ({}, {"action": "eat", "title": ["u"], "entities": ["y"], "topic": "q"}, None)]
    shape = ", ".join(f"{p}_{k} {t}" for p in "ab" for k, t in {"action": "string", "start": "long", "entities": "array<string>", "title": "array<string>", "topic": "string", "session": "int", "chain": "int"}.items())
    df = spark.createDataFrame([tuple((base | a).values()) + tuple((base | b).values()) for a, b, _ in cases], shape)
    assert [r[0] for r in df.select(G.relation("a", "b")).collect()] == [w for *_, w in cases]


def test_people(spark):
    seeds = spark.createDataFrame([(i,) for i in range(6)], "persona long")
    history = P.simulate(P.calendar(spark, seeds))
    got = rows(history, "persona", "session", "attribute")
    assert got == rows(P.simulate(P.calendar(spark, seeds.repartition(3))), "persona", "session", "attribute")
    state, last = {}, {}
    for p, s, a, before, after in got:
        assert after in P.MOVES[a][before] and state.get((p, a), before) == before
        assert s - last.get((p, a), -99) > P.REST[a]
        state[p, a], last[p, a] = after, s
    for r in P.static_conflicts(P.calendar(spark, seeds)).collect():
        assert r.point_a < r.distractor < r.point_b and r.point_b - r.point_a >= 5
    assert P.questions(history).count() == len(got)


def test_texts(spark):
    df = spark.createDataFrame([("Hello!!",), ("ok",), ("open settings now",), ("I love spicy noodles.",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.informative(F.col("t"))).collect()] == [False, False, False, True, False, False]
    assert [r[0] for r in df.select(X.topic(F.col("t"))).collect()] == ["general"] * 3 + ["food_preference"] + ["general"] * 2
    facts = df.select(X.stated_facts(F.col("t")).alias("f")).collect()[3].f
    assert [(f.key, f.object, f.value) for f in facts] == [("preference", "spicy noodles", True)]


def test_bm25_prefers_rare_terms(spark):
    nodes = spark.createDataFrame([(1, "apple pear pear"), (2, "apple"), (3, "apple plum"), (4, None)], "id long, text string")
    terms = S.probe_terms(spark.createDataFrame([(1, "apple pear")], "probe long, text string"))
    indexed = S.index(nodes, terms)
    best = S.bm25(S.postings(indexed), S.weighed(S.postings(indexed), terms, S.corpus_stats(indexed))).orderBy(F.desc("bm25")).first()
    assert best.id == 1 and best.n_terms == 2


def test_related_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    ev = [(i, f"k{rng.integers(0, 4)}", f"a{rng.integers(0, 3)}", int(c % 3), int(c), int(rng.integers(0, 25)), int(rng.choice([0, 1, 40_000, 86_399]))) for i, c in enumerate(rng.integers(0, 9, 120))]
    df = spark.createDataFrame(ev, "id long, k string, action string, topic long, chain long, day int, second long")
    own = lambda x: df.select(F.col("id").alias(x), *(v.alias(f"{x}_{n}") for n, v in {"action": F.col("action"), "start": F.col("day") * 86_400 + F.col("second"), "entities": F.array("k"), "title": F.array("action"), "topic": F.col("topic").cast("string"), "session": F.col("day"), "chain": F.col("chain")}.items()))
    pairs = own("a").crossJoin(own("b")).where("a < b").withColumn("type", G.relation("a", "b")).where("type IS NOT NULL")
    want = rows(pairs.groupBy("type").agg(F.count("*"), F.min("a"), F.max("b")), "type")
    assert rows(G.related(df), "type") == want and [w[0] for w in want] == ["CONTEXT_FOR", "FOLLOW_UP_OF", "SAME_EVENT"]


def _retrieved(found, edges, rounds, anchors, budget, barren):
    """What R.retrieve's pool holds (probe, id, hop), probe by probe, with all edges explicit CAUSES and no relevance."""
    out = set()
    for probe in {p for p, _, _ in found}:
        score, hop, used, idle = {i: s for p, i, s in found if p == probe}, {i: 0 for p, i, _ in found if p == probe}, set(), 0
        for turn in range(1, rounds + 1):
            chosen = sorted((i for i in score if i not in used), key=lambda i: (-score[i], i))[:anchors]
            new = {}
            for a in chosen:
                for n in sorted({y if x == a else x for x, y in edges if a in (x, y)})[:budget]:
                    if n not in score:
                        new[n] = max(new.get(n, -9.0), round(0.8 * score[a], 6))
            used |= set(chosen)
            score |= {n: round(s - 0.08 * turn, 6) for n, s in new.items()}
            hop |= dict.fromkeys(new, turn)
            idle = 0 if new else idle + 1
            if idle >= barren:
                break
        out |= {(probe, i, hop[i]) for i in score}
    return out


def test_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(100, 110)]
    late = [(200, 201), (201, 200), (210, 211), (211, 212)]  # 210 is the fifth best, so its turn comes after a barren round
    random = [(int(a), int(b)) for a, b in rng.integers(0, 40, (60, 2)) if a != b]
    edges = sorted(set(chain + late + random))
    found = [(1, 100, 1.0), *((2, i, 0.9) for i in (200, 201, 202, 203)), (2, 210, 0.5), *((3, int(i), round(float(s), 3)) for i, s in zip(range(5), rng.random(5), strict=True))]
    df = spark.createDataFrame([(*e, "CAUSES", "explicit", 1.0) for e in edges], "source long, target long, type string, trust string, confidence double")
    none = spark.createDataFrame([], "probe long, node long, rel double")
    start = spark.createDataFrame(found, "probe long, id long, score double")
    got = {(r.probe, r.id, r.hop) for r in R.retrieve(start, df, none, limit=1000).collect()}
    assert got == _retrieved(found, edges, 8, 4, 4, 2)
    assert {(1, 108, 8), (2, 211, 2), (2, 212, 3)} <= got and (1, 109, 9) not in got


def test_every_answer_meets_every_reference(spark):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(rng.choice(["the", "cat", "Sat", "on", "mat", "dog", "ran;", "far||away"], n))
    answers = [(i, text(int(n))) for i, n in enumerate([0, 1, 3, 9, 30, 60])] + [(6, None), (100, "cat")]
    refs = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 12, 50))] + [(50, ""), (51, "cat")]
    a, b = spark.createDataFrame(answers, "doc_id long, answer string"), spark.createDataFrame(refs, "item_id long, reference string")
    words = lambda t: (t or "").lower().split()
    want = {(i, j): round(A.bleu(words(x), words(y)), 9) for i, x in answers for j, y in refs}
    for block in (10_000, 11):
        got = A.bleu_pairs(a, b, block).collect()
        assert {(r.doc_id, r.item_id): round(r.bleu, 9) for r in got} == want and len(got) == len(want)
    credit = a.crossJoin(b).select("doc_id", "item_id", A.partial_credit(F.col("answer"), F.col("reference")))
    assert rows(A.credits(a, b), "doc_id", "item_id") == rows(credit, "doc_id", "item_id")


def test_bleu_scores_has_all_pairs(spark, data):
    from mnemospark.plans import registry

    n = spark.read.parquet(f"{data}/documents.parquet").count() * spark.read.parquet(f"{data}/benchmark.parquet").count()
    assert registry.queries()["bleu_scores"](spark, data).select("doc_id", "item_id").distinct().count() == n


def test_all_orders_merge(spark, data):
    from mnemospark.plans import registry

    over: dict = {}

    def top(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for r in spark.read.parquet(f"{data}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        a, b = top(r.o_custkey * 2), top(r.o_orderkey % 500 * 2 + 1)
        over[max(a, b)] = min(a, b)
    assert {r.id: r.canonical for r in registry.queries()["merge_entities"](spark, data).collect()} == {x: top(x) for x in list(over)}


def test_exact_mentions_equal_brute_force(spark):
    terms = [(1, "ann"), (1, "a"), (1, "joanna"), (2, "hannover"), (2, "z"), (3, "nobody")]
    names = [(1, "ann"), (2, "joann"), (3, "hanno"), (4, "z-axis"), (5, "ab"), (6, "annann")]
    score = lambda t, m: 1.0 if t == m else 0.8 if len(t) > 1 and t in m else 0.6 if len(m) > 1 and m in t else 0.0
    want: dict = {}
    for p, t in terms:
        for i, m in names:
            want[p, i] = max(want.get((p, i), 0.0), score(t, m))
    got = S.exact_mentions(spark.createDataFrame(terms, "probe long, term string"), spark.createDataFrame(names, "id long, mention string"))
    assert {(r.probe, r.id): r.score for r in got.collect()} == {k: x for k, x in want.items() if x}


def test_lives(spark):
    people = spark.createDataFrame([(i, 1960 + i * 2) for i in range(30)], "persona long, born int").withColumn("drive", GEN.drivers(F.lit("ENFJ"), F.array(F.lit("calm")), F.lit("family")))
    sessions = P.calendar(spark, people.select("persona")).join(people, "persona")
    got = rows(GEN.lives(sessions), "persona", "session", "attribute")
    assert got == rows(GEN.lives(sessions.repartition(5)), "persona", "session", "attribute")
    dates = {(r.persona, r.session): r.date.year for r in sessions.collect()}
    state, last, born = {}, {}, {r.persona: r.born for r in people.collect()}
    for p, s, a, field, before, after in got:
        assert before != after and state.get((p, field), before) == before and s - last.get((p, a), -99) > GEN.REST[a]
        if a == "Children_Status":
            assert state[p, "Marital_Status"] == "Married" and int(after) == int(before) + 1 <= GEN.MOST_CHILDREN and dates[p, s] - born[p] >= GEN.LEAST_AGE
        if a == "Marital_Status":
            assert after in GEN.MARITAL[before]
        if a == "Residence":
            assert after.split(", ")[0] in GEN.CITIES[after.split(", ")[1]]
        state[p, field], last[p, a] = after, s
    assert {a for _, _, a, *_ in got} == {*GEN.OFTEN, *GEN.SELDOM} and GEN.lives(sessions.limit(0)).count() == 0


def test_conditional_distractors_lie_between(spark):
    groups = spark.createDataFrame([(p, c, 2 + c % 3, 3 + p * 4) for p in range(6) for c in range(5)], "persona long, conflict long, rules int, sessions int")
    points = GEN.conditional_points(groups)
    talk = spark.createDataFrame([(p, s) for p in range(6) for s in range(0, 30, 3)], "persona long, session int")
    by = {}
    for r in points.collect():
        by.setdefault((r.persona, r.conflict), []).append((r.role, r.session))
    for own in by.values():
        at = [s for _, s in sorted(own)]
        assert at == sorted(set(at)) and 0 <= at[0] <= 9
    for r in GEN.between(points, talk).collect():
        at = [s for _, s in by[r.persona, r.conflict]]
        inner = range(min(at) + 1, max(at))
        assert r.session in inner and (r.session % 3 == 0 or not any(s % 3 == 0 for s in inner))


def test_long_contexts(spark):
    items = spark.createDataFrame([(i, 10 + i * 7 % 90) for i in range(40)] + [(99, 0)], "item long, tokens long")
    needs = spark.createDataFrame([(1, 300), (2, 0), (3, 10**9)], "persona long, tokens long")
    drawn = rows(GEN.supplements(items, needs), "persona", "place")
    one, three = ([r for r in drawn if r[0] == p] for p in (1, 3))
    assert sum(t for *_, t, _ in one) >= 300 > sum(t for *_, t, _ in one[:-1]) and len(three) == 40 and [r[3] for r in one] == list(range(len(one))) and not [r for r in drawn if r[0] == 2]
    grouped = rows(GEN.new_sessions(GEN.supplements(items, needs), 120), "persona", "place")
    want, group, size = [], 0, 0
    for r in three:
        if size and size + r[2] > 120:
            group, size = group + 1, 0
        size += r[2]
        want.append(group)
    assert [r[4] for r in grouped if r[0] == 3] == want
    old = spark.createDataFrame([(1, s) for s in range(4)], "persona long, session int")
    new = spark.createDataFrame([(1, 0), (1, 1), (1, 1)], "persona long, group long")
    out = rows(GEN.renumbered(old, new), "number")
    assert [r[1] for r in out] == list(range(6)) and [r[2] for r in out if r[2] is not None] == [0, 1, 2, 3] and {r[3] for r in out if r[3] is not None} == {0, 1}


def test_controller_evidence(spark):
    c = [(1, i, 1.0 - i / 100, ["a"] if i in (5, 6, 7) else ["b"] if i == 9 else [], i in (3, 4, 8), i == 10) for i in range(12)]
    df = spark.createDataFrame(c, "probe long, id long, score double, targets array<string>, cited boolean, protected boolean")
    needs = spark.createDataFrame([(1, ["a", "b", "z"])], "probe long, targets array<string>")
    got = [r.id for r in SEL.controller_evidence(df, needs, limit=8, previous=2).orderBy("rank").collect()]
    assert got == [5, 6, 9, 3, 4, 10, 0, 1]


def test_first_open_move(spark):
    moves = [(1, "a1", "r1", "CAUSES", "out", False, True), (1, "a2", "r2", "CAUSES", "out", True, True), (1, "a10", "r2", "SOURCE_EVIDENCE_LOOKUP", "lookup", True, True), (2, "a1", "r1", "CAUSES", "out", True, False), (2, "a2", "r3", "SOURCE_EVIDENCE_LOOKUP", "lookup", True, False)]
    df = spark.createDataFrame(moves, "probe long, action_id string, source string, action string, direction string, local boolean, wants_source boolean")
    pick = lambda tried: {r.probe: r.action_id for r in I.first_open(df, df.where(tried)).collect()}
    assert pick("false") == {1: "a10", 2: "a1"} and pick("action_id IN ('a10', 'a1')") == {1: "a2", 2: "a2"} and pick("true") == {}


def test_running_sums_over_any_group(spark):
    df = spark.createDataFrame([(None if i % 3 else "k", i, i % 5) for i in range(500)], "k string, i long, v long")
    got = {r.i: r.s for r in W.running(df.repartition(7), ["k"], ["i"], F.col("v"), "s").collect()}
    assert got == {i: sum(j % 5 for j in range(i + 1) if (j % 3 == 0) == (i % 3 == 0)) for i in range(500)}
    assert [r.n for r in W.running(df, [], ["i"], F.lit(1), "n").orderBy("i").collect()] == list(range(1, 501))


def test_overlaps_of_any_length(spark):
    rng = random.Random(4)
    def spans(n):
        out = []
        for i in range(n):
            a = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(20_000))
            out.append((i, i % 2, a, a + datetime.timedelta(hours=rng.choice([0, 1, 30, 500, 20_000, 90_000]))))
        return out
    left, right = spans(60), [*spans(60), (99, 0, datetime.datetime(2024, 5, 1), datetime.datetime(9999, 1, 1))]
    l, r = spark.createDataFrame(left, "l long, k int, ls timestamp_ntz, le timestamp_ntz"), spark.createDataFrame(right, "r long, k int, rs timestamp_ntz, re timestamp_ntz")
    got = sorted((x.l, x.r) for x in T.overlapping(l, r, ["k"]).collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert T.overlapping(l.limit(0), r, ["k"]).count() == 0


def test_bm25_is_exact_past_wide_terms(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(["the", "of"] * rng.randrange(3) + rng.choices([f"w{j}" for j in range(60)], k=rng.randrange(1, 12)))) for i in range(400)]
    nodes = spark.createDataFrame([*texts, (999, None), (998, "")], "id long, text string")
    probes = spark.createDataFrame([(1, "the w3 w4"), (2, "the of"), (3, "w5"), (4, "nothing here"), (5, "of w7 the w8 w9")], "probe long, text string")
    terms = S.probe_terms(probes)
    indexed = S.index(nodes, terms)
    weights = S.weighed(S.postings(indexed), terms, S.corpus_stats(indexed))
    want = rows(S.ranked(S.bm25(S.postings(indexed), weights).select("probe", "id", "n_terms", F.round("bm25", 6).alias("score")), ["probe"], [F.desc("score"), F.col("id")], 7), "probe", "rank")
    assert rows(S.bm25_top(S.postings(indexed), weights, 7), "probe", "rank") == want and {r[0] for r in want} == {1, 2, 3, 5}


def test_selected_places():
    assert M.selected("0,4,18-20, 4") == [0, 4, 18, 19, 20]
    for bad in ("", "3-1", "a", "1-"):
        with pytest.raises(ValueError, match="no place"):
            M.selected(bad)


def test_times_read_nothing_from_nothing(spark):
    said = [None, "", "2024-02-30", "February 30, 2023", "13:00 pm on 1 May 2020", "last weekend", "in a couple months", "on Friday.", "the day after tomorrow", "2024-01-05 through 2024-01-03"]
    df = spark.createDataFrame([(i, s, datetime.datetime(2024, 2, 29, 13)) for i, s in enumerate(said)], "i int, s string, at timestamp_ntz")
    got = {r.i: (r.t.starts, r.t.ends, r.t.method) for r in TIMES.with_times(df, F.col("s"), F.col("at")).collect()}
    assert got[0][2] == got[1][2] == "missing_expression" and {got[i][2] for i in (2, 3, 4, 9)} == {"ambiguous_or_unsupported"}
    assert got[5] == ("2024-02-24", "2024-02-25", "relative_last_weekend") and got[7] == ("2024-03-01", "2024-03-01", "relative_weekday_defaulted") and got[8][0] == "2024-03-02" and got[6][2] == "ambiguous_quantifier"
    none = TIMES.with_times(df.withColumn("at", F.lit(None).cast("timestamp")), F.col("s"), F.col("at")).where("i = 5").first().t
    assert none.method == "missing_anchor" and none.starts is None


def test_draws_grow_with_the_need(spark):
    """Longer items come as often as their length says, and rows are those that are needed, not personas times items."""
    items = spark.range(2000).selectExpr("id AS item", "CASE WHEN id % 2 = 0 THEN 30L ELSE 10L END AS tokens")
    needs = spark.range(400).selectExpr("id AS persona", "CASE id WHEN 0 THEN 39000L ELSE 100L END AS tokens")
    drawn = GEN.supplements(items, needs).collect()
    one = [r for r in drawn if r.persona > 0]
    long = sum(r.tokens == 30 for r in one)
    assert 0.71 < long / len(one) < 0.79 and len(one) < 400 * 8  # 30 to 10 is three in four
    by = {}
    for r in sorted(drawn, key=lambda r: (r.persona, r.place)):
        by.setdefault(r.persona, []).append(r)
    assert len(by) == 400 and all(len({r.item for r in own}) == len(own) and [r.place for r in own] == list(range(len(own))) for own in by.values())
    for p, own in by.items():
        need = 39_000 if p == 0 else 100
        assert sum(r.tokens for r in own) >= need > sum(r.tokens for r in own[:-1])
    first = GEN.draws(spark.createDataFrame([(7, 4, 4), (8, 6, 10)], "item long, tokens long, upto long"), 10, 2, spark.createDataFrame([(1, 0, 999)], "persona long, first long, last long")).collect()
    assert len(first) == 1000 and 550 < sum(r.item == 8 for r in first) < 650
    assert GEN.supplements(items.limit(0), needs).collect() == []


def test_lives_follow_the_space_of_a_file(spark, tmp_path):
    """Moves, children, rests and cities are those that the file tells; the timeline joins up and ends with plans."""
    told = {"marital": {"Alone": ["Married"], "Married": ["Alone"]}, "cities": {"Iceland": ["Akureyri"], "Chile": ["Arica", "Iquique"]}, "rest": dict(GEN.REST, Children_Status=2, Residence=6), "most_children": 2, "least_age": 30, "begins": {"Marital_Status": "Married"}}
    (tmp_path / "space.json").write_text(json.dumps(told))
    space = GEN.read_space(spark, str(tmp_path / "space.json"))
    drive = F.struct(*(F.lit(float(w)).alias(a) for a, w in GEN.READINESS.items()))
    sessions = spark.range(6).select(F.col("id").alias("persona"), F.explode(F.sequence(F.lit(0), F.lit(46))).alias("session"), F.lit(1992).alias("born")).withColumn("date", F.add_months(F.lit("2020-01-31").cast("date"), F.col("session"))).withColumn("drive", drive)
    changes = GEN.lives(sessions, space)
    got = sorted((r.persona, r.session, r.attribute, r.field, r.before, r.after) for r in changes.collect())
    last, kids = {}, {}
    for p, s, a, f, before, after in sorted(got, key=lambda r: r[:2]):
        assert s - last.get((p, a), -99) > space.rest[a]
        last[p, a] = s
        if f == "Marital_Status":
            assert after in told["marital"][before]
        if f == "Residence":
            assert after in ("Akureyri, Iceland", "Arica, Chile", "Iquique, Chile") and after != before
        if f == "Children_Status":
            assert int(after) == int(before) + 1 <= 2 and 2020 + s // 12 - 1992 >= 30
            kids[p] = int(after)
    assert kids and {r[3] for r in got} >= {"Marital_Status", "Residence", "Children_Status"}
    line = GEN.timeline(sessions.select("persona", "session", "date"), changes, space.first()).orderBy("persona", "session").collect()
    assert len(line) == 6 * 48 and {r.kind for r in line} == {"update", "future_plan"}
    for one, two in zip(line, line[1:], strict=False):
        assert one.persona != two.persona or one.after == two.before
        assert (one.kind == "update") == (one.before != one.after) == bool(one.updated)
    assert all(r.after["Children_Status"] == str(kids.get(r.persona, 0)) and str(r.date) == "2026-01-15" for r in line if r.kind == "future_plan")
    (tmp_path / "bad.json").write_text(json.dumps({"marital": {"Alone": ["Gone"]}, "cities": {"Chile": ["Arica"]}}))
    with pytest.raises(ValueError, match="leads nowhere; .*fewer than two cities"):
        GEN.read_space(spark, str(tmp_path / "bad.json"))


def test_static_points_by_hand(spark):
    """Every rung of the ladder is met; places are those of a loop that follows it."""
    r, unit = random.Random(4), lambda *p: int(hashlib.sha256("|".join(map(str, p)).encode()).hexdigest()[:13], 16) / 2**52
    kinds = {p: [r.choice(["chitchat", "update"]) if p % 2 else "update" for _ in range(n)] for p, n in enumerate((48, 14, 9, 3, 2, 1, 12, 20))}
    conflicts = [(p, 100 * p + c, c % 3 > 0) for p in kinds for c in range(9)]
    want = {}
    for p, own in kinds.items():
        n, taken = len(own), set()
        starts = sorted((s for s in range(n - 1) if s <= 9), key=lambda s: unit(p, s, "A"))
        for turn, (_, c, distractor) in enumerate(sorted((x for x in conflicts if x[0] == p), key=lambda x: unit(p, x[1], "order"))):
            if not starts:
                continue
            a = starts[turn % len(starts)]
            taken.add(a)
            want[p, c, "Point_A"] = (a, 0)
            later = list(range(a + 1, n - 1))
            rungs = [[s for s in later if s - a >= 5 and own[s] == "chitchat" and s not in taken], [s for s in later if s - a >= 5 and s not in taken], [s for s in later if s not in taken], later]
            rung = next((k for k, some in enumerate(rungs) if some), None)
            if rung is None:
                continue
            b = rungs[rung][int(unit(p, c, "B") * len(rungs[rung]))]
            taken.add(b)
            want[p, c, "Point_B"] = (b, rung)
            rungs = [[s for s in range(a + 1, b) if s not in taken], list(range(a + 1, b))]
            rung = next((k for k, some in enumerate(rungs) if some), None)
            if distractor and rung is not None:
                d = rungs[rung][int(unit(p, c, "D") * len(rungs[rung]))]
                taken.add(d)
                want[p, c, "Distractor"] = (d, rung)
    df = spark.createDataFrame(conflicts, "persona long, conflict long, distractor boolean")
    sessions = spark.createDataFrame([(p, s, k) for p, own in kinds.items() for s, k in enumerate(own)], "persona long, session int, kind string")
    got = {(x.persona, x.conflict, x.role): (x.session, x.rung) for x in GEN.static_points(df, sessions, gap=5).collect()}
    assert got == want and {k for (_, _, role), (_, k) in want.items() if role == "Point_B"} == {0, 1, 2, 3}
    assert GEN.static_points(df.limit(0), sessions).collect() == []


def test_cross_scope_counts_equal_the_pairs(spark):
    import datetime
    import random

    from mnemospark.operators import memory as M

    r = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, r.choice("abcde"), r.choice(["go", "eat", None]), r.choice(["t", "u", None]), r.choice(["x", "y", "z", None]), None if r.random() < 0.1 else start + datetime.timedelta(hours=12 * r.randint(0, 80), milliseconds=r.choice([0, 0, 400])), r.choice([["p"], ["q"], ["p", "q"], []])) for i in r.sample(range(1_000), 200)]
    nodes = spark.createDataFrame(rows, "id long, scope string, action string, topic string, entity string, starts timestamp, speakers array<string>")
    members = spark.createDataFrame([("a", ["p", "q"]), ("b", ["p"]), ("c", ["q", "p", "z"]), ("d", ["q"])], "scope string, participants array<string>")
    made = M.cross_scope_candidates(nodes, members)
    want = {}
    for x in made.collect():
        n, w = want.get(x.type, (0, 0))
        want[x.type] = n + 1, w + x.source % 101
    counts = M.cross_scope_counts(nodes, members, F.col("id") % 101)
    assert {x.type: (x.pairs, x.sources) for x in counts.collect()} == want and len(want) == 3
    assert M.cross_scope_counts(nodes.limit(0), members, F.col("id")).collect() == []
    # chunks of few rows, so that groups go on in others
    few = {x.type: (x.pairs, x.sources) for x in M.cross_scope_counts(nodes, members, F.col("id") % 101, chunk=9).collect()}
    assert few == want


def test_above_like_a_loop():
    from mnemospark.operators import memory as M

    rng = np.random.default_rng(6)
    own, asked = ([rng.integers(0, 3, n), rng.integers(0, 20, n), rng.integers(0, 30, n)] for n in (150, 90))
    want = [sum(k == key and x <= a and y > b for k, x, y in zip(*own, strict=True)) for key, a, b in zip(*asked, strict=True)]
    assert M._above(tuple(own), tuple(asked)).tolist() == want and sum(want) > 100
    assert M._above(tuple(x[:0] for x in own), tuple(x[:0] for x in asked)).tolist() == []


def test_controller_evidence_of_many_probes_like_a_loop(spark):
    """Against the choice by hand, row by row, for probes of one to forty rows with ties, in one pass without a group for each."""
    many = [(p, i, float(i * 7 % 5), [x for x in "abcd" if (i + p) % (3 + ord(x) % 4) == 0], i % 3 == p % 3, i % 5 == 0) for p in range(40) for i in range(p + 1)]
    needs = ["b", "a", "z", "d"]
    want = []
    for p in range(40):
        own = sorted((r for r in many if r[0] == p), key=lambda r: (-r[2], r[1]))
        chosen: list = []
        for t in needs:
            for r in (r for r in own if t in r[3]):
                if r not in chosen and len(chosen) < 7:
                    chosen.append(r)
                if sum(t in c[3] for c in chosen) >= 2:
                    break
        for r in [*[r for r in own if r[4] and r not in chosen][:2], *[r for r in own if r[5]], *own]:
            if r not in chosen and len(chosen) < 7:
                chosen.append(r)
        want += [(p, r[1], r[2], k) for k, r in enumerate(chosen, 1)]
    df = spark.createDataFrame(many, "probe long, id long, score double, targets array<string>, cited boolean, protected boolean")
    got = SEL.controller_evidence(df, df.select("probe").distinct().withColumn("targets", F.array(*map(F.lit, needs))), limit=7, previous=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_distractors_make_no_row_for_each_session_between(spark):
    points = spark.createDataFrame([(p, c, "Point_A", c) for p in range(3) for c in range(4)] + [(p, c, "Point_B", c + 2 + 9 * p) for p in range(3) for c in range(4)], "persona long, conflict long, role string, session int")
    talk = spark.createDataFrame([(0, 2), (1, 5), (1, 7), (5, 3)], "persona long, session int")
    unit = lambda *parts: int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)
    said = {(r.persona, r.session) for r in talk.collect()}
    want = {(p, c, min(((p, s) not in said, unit(p, c, s), s) for s in range(c + 1, c + 2 + 9 * p))[2]) for p in range(3) for c in range(4)}
    got = GEN.between(points, talk)
    assert set(map(tuple, got.collect())) == want and dict(got.dtypes)["session"] == "int"
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_lives_sort_narrow_rows_in_all_partitions(spark):
    people = spark.range(40).select(F.col("id").alias("persona"), F.lit(1980).alias("born"), GEN.drivers(F.lit("ENFJ"), F.array(F.lit("calm")), F.lit("family")).alias("drive"))
    lived = GEN.lives(P.calendar(spark, people.select("persona")).join(people, "persona"))
    plan = lived._jdf.queryExecution().executedPlan().toString()
    sort = plan[plan.index("Sort [persona") :]
    assert "REPARTITION_BY_NUM" in plan and "sha2" not in sort[: sort.index("Exchange")] and "to_json" not in plan
    assert lived.where("persona = 7").count() > 40
