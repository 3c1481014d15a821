"""Facts of many lines are dealt once, by order, over as many tasks as their number needs."""

from mnemospark.functions import shared
from mnemospark.plans import registry, runs


def test_one_deal_serves_all(spark, data, monkeypatch):
    want = {tuple(r) for r in registry.queries()["slimmed_facts"](spark, data).collect()}
    monkeypatch.setattr(runs, "sized", lambda df, rows, *keys, most: shared.sized(df, rows, *keys, most=300))
    got = registry.queries()["slimmed_facts"](spark, data)
    assert {tuple(r) for r in got.collect()} == want
    shuffles = [x for x in got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and all("REPARTITION_BY_NUM" in x and "hashpartitioning(probe" in x for x in shuffles)
