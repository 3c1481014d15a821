"""Mentions of terms in names, against a loop by hand; and that neither mentions nor pairs become shuffled rows."""

import random

import pytest

from mnemospark.operators import search as S
from mnemospark.plans import registry


@pytest.mark.parametrize("block", [2, 10_000])
@pytest.mark.parametrize("held", [1000, 64_000_000])
def test_mentioned_like_a_loop(spark, block, held):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("aabé") for _ in range(draw.randint(1, 5)))
    terms = [(p, word()) for p in range(7) for _ in range(4)] + [(7, "\x00a"), (8, None)]
    said = [(i % 40, [word() for _ in range(i % 5)]) for i in range(60)] + [(50, None), (51, ["\x00a", None, "a\x00a"]), (None, ["ab"])]
    score = lambda t, m: 1.0 if t == m else 0.8 if len(t) > 1 and t in m else 0.6 if len(m) > 1 and m in t else 0.0
    want: dict = {}
    for p, t in terms:
        for i, names in said:
            for m in names or []:
                if t is not None and m is not None and score(t, m):
                    want[p, i] = max(want.get((p, i), 0.0), score(t, m))
    got = S.mentioned(spark.createDataFrame(terms, "probe long, term string"), spark.createDataFrame(said, "id long, names array<string>").repartition(3), block, held).collect()
    assert len(got) == len(want) and {(r.probe, r.id): r.score for r in got} == want
    assert S.mentioned(spark.createDataFrame([], "probe long, term string"), spark.createDataFrame(said, "id long, names array<string>")).count() == 0


def test_only_the_names_of_an_id_are_shuffled(spark, data):
    found = registry.queries()["exact_mentions"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange") == 1 and "Join" not in found
