"""The planner's loop against a loop by hand, question by question; its probes' ladder."""

import random

from pyspark.sql import functions as F

from mnemospark.operators import planner as P

TARGET = "question long, target string, required boolean, facets array<string>, query string, must array<string>, should array<string>, entities array<string>"
MOVE = "source long, action string, direction string, priority int, id long, score double"
LADDER = "question long, target string, query string, must array<string>, should array<string>, entities array<string>, missing array<string>"


def by_hand(targets, nodes, moves, facets, rounds=8, barren=2, first=12, later=6, actions=3, reach=4):
    paths = {}
    for s, a, d, p, i, x in sorted(moves, key=lambda m: (-m[5], m[4])):
        paths.setdefault((s, a, d), []).append((p, i, x))
    paths = {k: v[:reach] for k, v in paths.items()}

    def search(q, must, should, entities, most):
        asked, out = set(must) | set(should) | set(entities), []
        for i, terms in nodes.get(q, {}).items():
            if set(must) <= terms and asked & terms:
                out.append((-round(len(asked & terms) / len(asked), 6), i))
        return {i: -s for s, i in sorted(out)[:most]}

    evidence, outcome, log = {}, {}, []
    for q in sorted({t[0] for t in targets}):
        own = {t[1]: dict(required=t[2], facets=t[3] or [], query=t[4], must=t[5] or [], should=t[6] or [], entities=t[7] or [], stage=0, zero=0, out=-1, prints=[]) for t in targets if t[0] == q}
        mark = lambda t: (t["query"].lower().strip(), tuple(sorted(set(t["must"]))), tuple(sorted(t["entities"])), tuple(sorted(t["should"])))
        pool = {}
        for n, t in own.items():
            t["prints"].append(mark(t))
            pool[n] = {i: (s, 0) for i, s in search(q, t["must"], t["should"], t["entities"], first).items()}
        tried, reason = {n: set() for n in own}, None
        for turn in range(1, rounds + 1):
            known = {}
            for found in pool.values():
                for i, (s, r) in found.items():
                    s0, r0 = known.get(i, (s, r))
                    known[i] = (max(s, s0), min(r, r0))
            active, ready, missing = [], {}, {}
            for n, t in own.items():
                have = {f for i in (known if n == "root" else pool[n]) for f in facets.get(i, ())}
                missing[n] = sorted(set(t["facets"]) - have)
                counts = bool(missing[n]) and (n == "root" or t["required"])
                ready[n] = [k for k in paths if k[0] in known and k not in tried[n]] if counts else []
                newest = max((known[k[0]][1] for k in ready[n]), default=-1)
                if counts and (t["out"] < 0 or newest >= t["out"]):
                    active.append(n)
            if not any(missing[n] and (n == "root" or own[n]["required"]) for n in own):
                reason = ("sufficient", turn - 1)
                break
            if not active:
                reason = ("exhausted", turn - 1)
                break
            gained = {}
            for n in active:
                t, got, how = own[n], {}, None
                order = sorted(ready[n], key=lambda k: (not (n == "root" or k[0] in pool[n]), k[1] != "SOURCE_EVIDENCE_LOOKUP", paths[k][0][0], *k))[:actions]
                for k in order:
                    tried[n].add(k)
                    for _, i, x in paths[k]:
                        got[i] = max(got.get(i, x), x)
                if t["required"] and n != "root" and t["zero"] > 0 and t["stage"] == 0:
                    go = [m for m in t["must"] if not any(m.lower() in e.lower() for e in t["entities"])]
                    stay = [m for m in t["must"] if m not in go]
                    new = dict(t, must=stay)
                    if go:
                        new["should"], kind = list(dict.fromkeys([*t["should"], *go])), "relaxed"
                    else:
                        new["query"] = " ".join(x for x in (" ".join(t["entities"]), t["query"].strip(), (" ".join(missing[n]) or "related") + " supporting evidence") if x)
                        new["should"], kind = list(dict.fromkeys([*t["should"], *missing[n]])), "diversified"
                    if mark(new) not in t["prints"]:
                        how = kind
                        for i, x in search(q, new["must"], new["should"], new["entities"], later).items():
                            got[i] = max(got.get(i, x), x)
                        t.update({c: new[c] for c in ("query", "must", "should")}, stage=1)
                        t["prints"].append(mark(new))
                gained[n] = (got, len(order), how)
            for n, (got, k, how) in gained.items():
                t, growth = own[n], sum(i not in known for i in got if i not in pool[n])
                may = t["required"] and n != "root" and t["stage"] == 0 and t["zero"] == 0
                t["zero"] = 0 if growth else t["zero"] + 1
                t["out"] = turn if t["zero"] >= barren or (k == 0 and how is None and not may) else -1
                log.append((q, n, turn, tuple(missing[n]), how, k, growth))
            for n, (got, _, _) in gained.items():
                for i, x in got.items():
                    pool[n].setdefault(i, (x, turn))
        outcome[q] = reason or ("rounds", rounds)
        known = {}
        for found in pool.values():
            for i, (s, r) in found.items():
                s0, r0 = known.get(i, (s, r))
                known[i] = (max(s, s0), min(r, r0))
        cited = set()
        for n, t in own.items():
            mine = {i: s for i, (s, _) in (known if n == "root" else pool[n]).items()}
            for f in set(t["facets"]):
                having = [(-s, i) for i, s in mine.items() if f in facets.get(i, ())]
                cited |= {min(having)[1]} if having else set()
        evidence[q] = sorted(((i not in cited, -s, i, r) for i, (s, r) in known.items()))[:16]
    return evidence, outcome, log


def table(seed):
    r = random.Random(seed)
    nodes = {q: {i: {r.choice("abcdefgh") for _ in range(3)} for i in range(100 * q, 100 * q + 25)} for q in range(14)}
    ids = [i for own in nodes.values() for i in own]
    facets = {i: {r.choice(["f1", "f2", "f3", "f4", "f5", "f6", "rare"][:6] + (["rare"] if r.random() < 0.05 else []))} for i in ids}
    moves = {(s, r.choice(["NEXT", "CAUSES", "SOURCE_EVIDENCE_LOOKUP"]), r.choice(["forward", "backward"]), r.randint(1, 3), min(max(s + r.choice([-2, -1, 1, 2, 3, 100]), 0), 1325), round(r.random(), 3)) for s in ids for _ in range(r.choice([0, 0, 1, 2]))}
    by_path = {}
    for m in sorted(moves):
        by_path[m[:3]] = min(by_path.get(m[:3], 9), m[3])
    moves = [(*m[:3], by_path[m[:3]], *m[4:]) for m in sorted(moves)]
    targets = []
    for q in range(14):
        targets.append((q, "root", True, r.sample(["f1", "f2", "f3", "f4"], 2) + (["never"] if q % 3 == 0 else []), "all of it", [], ["a", "b"], []))
        targets.append((q, "s1", True, ["f5", "rare"] if q % 2 else ["f1"], "first part", ["a", "h"], ["c"], ["h and others"] if q % 4 == 0 else []))
        targets.append((q, "s2", q % 5 > 0, ["f6"], "second part", [], ["z"], [] if q % 2 else ["g"]))
    return targets, nodes, moves, facets


def test_loop_equals_loop_by_hand(spark):
    targets, nodes, moves, facets = table(4)
    evidence, outcome, log = by_hand(targets, nodes, moves, facets)
    rows = spark.createDataFrame([(q, i, t) for q, own in nodes.items() for i, terms in own.items() for t in terms], "question long, id long, term string")
    tells = spark.createDataFrame([(i, f) for i, own in facets.items() for f in own], "id long, facet string")
    got, ended, said = P.run(spark.createDataFrame(targets, TARGET), P.by_terms(rows), spark.createDataFrame(moves, MOVE), tells)
    assert {r.question: (r.reason, r.rounds) for r in ended.collect()} == outcome
    assert sorted(((r.question, r.target, r.round, tuple(r.missing), r.how, r.moves, r.growth) for r in said.collect()), key=repr) == sorted(log, key=repr)
    own = {}
    for r in got.orderBy("question", "rank").collect():
        own.setdefault(r.question, []).append((not r.cited, -r.score, r.id, r.turn))
    assert own == {q: e for q, e in evidence.items() if e}
    assert {"sufficient", "exhausted"} <= {x for x, _ in outcome.values()} and {"relaxed", "diversified"} <= {x[4] for x in log} and max(x[1] for x in outcome.values()) > 3


def test_no_targets(spark):
    empty = lambda s: spark.createDataFrame([], s)
    got, ended, said = P.run(empty(TARGET), P.by_terms(empty("question long, id long, term string")), empty(MOVE), empty("id long, facet string"))
    assert got.collect() == ended.collect() == said.collect() == []


def test_ladder_keeps_entities(spark):
    rows = [(1, "s", "who went", ["Ann", "paris"], ["trip"], ["Ann Lee"], ["time"]), (1, "t", " q ", ["Ann"], [], ["Ann Lee"], [])]
    df = spark.createDataFrame(rows, LADDER)
    assert [(r.target, r.must, r.should) for r in P.relaxed(df).collect()] == [("s", ["Ann"], ["trip", "paris"])]
    got = {r.target: (r.query, r.must, r.should) for r in P.diversified(df).collect()}
    assert got == {"s": ("Ann Lee who went time supporting evidence", ["Ann"], ["trip", "paris", "time"]), "t": ("Ann Lee q related supporting evidence", ["Ann"], [])}


def test_spread_takes_what_differs(spark):
    rows = [(1, "s", 1, ["a", "b"], 0.9), (1, "s", 2, ["a", "b"], 0.8), (1, "s", 3, ["c", "d"], 0.1), (1, "s", 4, ["a", "c"], 0.5), (2, "s", 5, [], 0.5), (2, "s", 6, [], 0.5)]
    df = spark.createDataFrame(rows, "question long, target string, probe long, terms array<string>, score double")
    got = {(r.question, r.place): r.probe for r in P.spread(df, 3).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (1, 3): 4, (2, 1): 5, (2, 2): 6}
    assert P.spread(df, 2).where(F.col("place") > 2).count() == 0
