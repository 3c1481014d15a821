"""Rounds in which no probe asks again don't search."""

from mnemospark.operators import planner as P


def test_no_search_without_a_probe(spark):
    words = ("a", ["go"], [], [])
    targets = spark.createDataFrame([(1, "root", True, ["there"], *words)], "question long, target string, required boolean, facets array<string>, query string, must array<string>, should array<string>, entities array<string>")
    nodes = spark.createDataFrame([(1, 10, "go"), (1, 11, "on"), (1, 12, "on")], "question long, id long, term string")
    moves = spark.createDataFrame([(10, "NEXT", "forward", 1, 11, 0.5), (11, "NEXT", "forward", 1, 12, 0.5)], "source long, action string, direction string, priority int, id long, score double")
    facets = spark.createDataFrame([(12, "there")], "id long, facet string")
    calls, search = [], P.by_terms(nodes)
    evidence, outcome, _ = P.run(targets, lambda probes: calls.append(1) or search(probes), moves, facets, rounds=3)
    assert [tuple(r) for r in outcome.collect()] == [(1, "sufficient", 2)]
    assert {(r.id, r.turn, r.cited) for r in evidence.collect()} == {(10, 0, False), (11, 1, False), (12, 2, True)} and len(calls) == 1
