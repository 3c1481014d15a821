"""The stateful fold against a fold of the sorted rows; late rows, idle chains, progress."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from mnemospark.operators.state import Chain
from mnemospark.streaming import processor as P
from mnemospark.streaming.folds import run_to_table

OPERATION = "chain long, seq long, ts timestamp, op string, key string, value string, confidence double"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in P.STORE}
    for k, v in P.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows():
    r, out = random.Random(6), []
    for seq in range(160):
        out.append((r.randint(1, 4), seq, START + datetime.timedelta(minutes=r.randint(0, 2000)), r.choice(["add", "add", "reinforce", "replace", "retract"]), r.choice("ab"), r.choice(["x", "y"]), 0.5))
    return out


def test_rows_apply_in_order_of_time(spark, tmp_path, store):
    every = rows()
    random.Random(1).shuffle(every)
    end = START + datetime.timedelta(days=3)
    parts = [every[:80], every[80:], [(9, 1000, end, "add", "a", "x", 0.5)], [(1, 1001, START, "add", "a", "x", 0.5), (1, 1002, end + datetime.timedelta(hours=9), "add", "c", "x", 0.5), (9, 1003, end + datetime.timedelta(days=40), "add", "b", "x", 0.5)]]
    # as the watermark moves with the files, all of the first two come before it passes any of them
    for i, p in enumerate(parts):
        spark.createDataFrame(p, OPERATION).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        time.sleep(0.02)
    stream = spark.readStream.schema(OPERATION).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    listener = P.Progress(total=sum(map(len, parts)))
    spark.streams.addListener(listener)
    try:
        got = run_to_table(spark, P.fold_in_time(stream, "40 hours", idle_ms=20 * 86_400_000), "append", str(tmp_path / "run"))
        told = {(r.chain, r.seq): r for r in got.collect()}
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.streams.removeListener(listener)
    chains = {}
    for chain, seq, ts, op, key, value, confidence in sorted(every, key=lambda x: (x[2], x[1])):
        want = chains.setdefault(chain, Chain()).apply(op, key, value, confidence, ts)
        r = told[chain, seq]
        assert (r.decision, r.epoch, r.closed_value, r.confidence) == (want["decision"], want["epoch"], want["closed_value"], want["confidence"])
        assert (r.valid_to == ts) == (want["decision"] == "revise")
    assert told[1, 1001].decision == "late" and len(told) >= 162
    assert listener.rows == 164 and listener.remaining() == 0 and listener.ended == [None]
    # the chains that nothing came for are forgotten: what is left are the last rows
    assert listener.batches[-1]["state"] <= 12


def test_nothing_comes(spark, tmp_path, store):
    spark.createDataFrame([], OPERATION).write.parquet(f"{tmp_path}/in")
    got = run_to_table(spark, P.fold_in_time(spark.readStream.schema(OPERATION).parquet(f"{tmp_path}/in")), "append", str(tmp_path / "run"))
    assert got.where(F.lit(True)).collect() == []


def test_calls_to_the_store_grow_with_chains_not_rows():
    import collections

    import pandas as pd

    calls = collections.Counter()

    class State:
        def __init__(self, kind):
            self.kind, self.of = kind, {} if kind == "map" else []

        def __getattribute__(self, name):
            if not name.startswith("_") and name not in ("kind", "of"):
                calls[name] += 1
            return object.__getattribute__(self, name)

        def exists(self):
            return bool(self.of)

        def get(self):
            return iter(self.of) if self.kind == "list" else self.of

        def appendList(self, rows):  # noqa: N802
            self.of += rows

        def put(self, rows):
            self.of = list(rows)

        def clear(self):
            self.of = {} if self.kind == "map" else []

        def iterator(self):
            return iter(list(self.of.items()))

        def updateValue(self, k, v):  # noqa: N802
            self.of[k] = v

        def getValue(self, k):  # noqa: N802
            return self.of[k]

        def removeKey(self, k):  # noqa: N802
            del self.of[k]

        def keys(self):
            return list(self.of)

        def update(self, v):
            self.of = v

    class Handle:
        getMapState = lambda self, *a: State("map")  # noqa: E731, N815
        getListState = lambda self, *a: State("list")  # noqa: E731, N815
        getValueState = lambda self, *a: State("value")  # noqa: E731, N815

        def registerTimer(self, at):  # noqa: N802
            calls["timer"] += 1

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    f = P.Facts()
    f.init(Handle())
    n = 500
    frame = pd.DataFrame([(1, i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), "add", "a", "x", 0.5) for i in range(n)], columns=["chain", "seq", "ts", "op", "key", "value", "confidence"])
    list(f.handleInputRows((1,), iter([frame]), At(0)))
    first, end = int(frame.ts.iloc[0].timestamp() * 1000), int(frame.ts.iloc[-1].timestamp() * 1000)
    timers = At(end + 1)
    told = pd.concat(f.handleExpiredTimer((1,), timers, At(first)))
    assert list(told.seq) == list(range(n)) and sum(calls.values()) < 20


def test_events_of_the_last_moment_all_come(spark, tmp_path):
    from mnemospark.plans import registry

    rows = [(i, START + datetime.timedelta(hours=min(i, 20)), i % 3, "view", float(i * 7 % 100), "{}") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["stream_facts_in_time"](spark, str(tmp_path))
    want = registry.queries()["epoch_fold"](spark, str(tmp_path)).where("seq < 29")
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == sorted(map(tuple, want.collect()), key=lambda x: x[1])
