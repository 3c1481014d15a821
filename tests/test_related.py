"""Relations counted out of groups: what is found doesn't depend on how tasks are dealt or how many events are looked at first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import shared
from mnemospark.operators import graph as G


@pytest.mark.parametrize("most", [1, 1000])
def test_related_by_few_rows_a_task(spark, monkeypatch, most):
    """Two lone events come first and last, so the first ones that are related lie further in."""
    rng = np.random.default_rng(5)
    ev = [(i, f"k{rng.integers(0, 4)}", f"a{rng.integers(0, 3)}", int(c % 3), int(c), int(rng.integers(20, 40)), int(rng.choice([0, 1, 40_000, 86_399]))) for i, c in enumerate(rng.integers(0, 9, 150))]
    ev += [(-5, "lone", "x", 70, 70, 1, 0), (-4, "k0", "y", 71, 71, 1, 0), (900, "alone", "z", 80, 80, 60, 5)]
    by = {"SAME_EVENT": set(), "FOLLOW_UP_OF": set(), "CONTEXT_FOR": set()}
    for a in ev:
        for b in ev:
            if a[0] < b[0]:
                near = abs((a[5] - b[5]) * 86_400 + a[6] - b[6]) <= 604_800
                kind = "SAME_EVENT" if a[1:3] == b[1:3] else "FOLLOW_UP_OF" if a[3] == b[3] and a[5] != b[5] and near else "CONTEXT_FOR" if a[1] == b[1] and a[4] != b[4] else None
                if kind:
                    by[kind].add((a[0], b[0]))
    monkeypatch.setattr(G, "sized", lambda df, rows, *keys: shared.sized(df, rows, *keys, most=20))
    got = G.related(spark.createDataFrame(ev, "id long, k string, action string, topic long, chain long, day int, second long"), most=most)
    assert {tuple(r) for r in got.collect()} == {(t, len(p), min(a for a, _ in p), max(b for _, b in p)) for t, p in by.items()}
    assert G.related(got.select(*(F.lit(1).cast(t).alias(c) for c, t in (("id", "long"), ("k", "string"), ("action", "string"), ("topic", "long"), ("chain", "long"), ("day", "int"), ("second", "long")))).limit(0)).count() == 0


def test_rows_are_dealt_by_their_number(spark):
    df, n = spark.range(100), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shared.sized(df, 100, "id", most=10).rdd.getNumPartitions() == max(10, n) and shared.sized(df, 100, "id", most=100) is df
