"""The single-threaded twins give what their queries give, so bench.py compares equal work."""

import pytest

import twins
from mnemospark.plans import registry
from tests.conftest import DATA

COLUMNS = {
    "dense_topk": ("probe", "id", "score"), "bm25_or": ("probe", "id", "score"), "lexical_relevance": ("probe", "id", "score"), "merge_entities": ("id", "canonical"), "cumulative_cost": ("provider", "call", "line", "cost"),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_twin_equals_query(spark, name):
    plain = lambda r: tuple(round(float(x), 5) if isinstance(x, float) else x for x in r)
    mine = sorted(plain(r) for r in registry.queries()[name](spark, DATA).select(*COLUMNS[name]).collect())
    twin = sorted(plain(r) for r in twins.TWINS[name](DATA))
    assert len(mine) == len(twin) and sum(a == b for a, b in zip(mine, twin, strict=True)) >= 0.99 * len(mine)


def test_token_f1_twin(spark):
    mine = {r.doc_id: r.f1 for r in registry.queries()["token_f1"](spark, DATA).collect()}
    assert all(abs(mine.get(i, 0.0) - f1) < 1e-5 for i, f1 in twins.token_f1(DATA))
