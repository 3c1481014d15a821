"""The fact fold as a stateful processor: rows wait for the watermark, apply in order of their time, and idle chains go."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from mnemospark.functions.lazy import pd
from mnemospark.operators.state import Chain, Fact

APPLIED = "chain long, seq long, decision string, epoch int, closed_value string, confidence double, valid_from timestamp, valid_to timestamp"
_COLUMNS = [c.split()[0] for c in APPLIED.split(", ")]
#: The state store that keeps a key's state in parts; the default one can't.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Facts(StatefulProcessor):
    """One chain's facts, one state entry each, and the list of rows that wait: they are applied when the watermark passes their
    time, all that it has passed at once, so calls to the state store grow with chains and batches, not with rows.

    A row that comes after the watermark has passed its time is late: it changes nothing and is told as late. A chain
    that nothing was applied to for idle_ms of event time is forgotten; its facts' rows were told when they changed.
    """

    def __init__(self, idle_ms: int = 30 * 86_400_000):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getMapState("facts", "key string", "fact string")
        self.epoch = handle.getValueState("epoch", "epoch int, at long")
        self.waiting = handle.getListState("waiting", "at long, seq long, op string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            wait = []
            for r in frame.itertuples():
                at = int(r.ts.timestamp() * 1000)
                if at < passed:
                    late.append((key[0], int(r.seq), "late", self._epoch()[0], None, None, r.ts, None))
                else:
                    wait.append((at, int(r.seq), json.dumps([r.op, r.key, r.value, None if pd.isna(r.confidence) else r.confidence])))
            if wait:
                self.waiting.appendList(wait)
                self.handle.registerTimer(min(wait)[0])
        if late:
            yield pd.DataFrame(late, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = {(at, seq): op for at, seq, op in rows if at <= now or at < passed}
        epoch, last = self._epoch()
        if not due:
            if last is not None and now >= last + self.idle_ms:
                for state in (self.facts, self.epoch):
                    state.clear()
            return
        chain, out = Chain(epoch=epoch), []
        before = {k[0]: v[0] for k, v in self.facts.iterator()}
        chain.facts = {k: Fact(*json.loads(v)) for k, v in before.items()}
        stamp = lambda ms: None if ms is None else pd.Timestamp(ms, unit="ms")
        for at, seq in sorted(due):
            if last is not None and at > last + self.idle_ms:
                chain = Chain()
            last = at
            op, name, value, confidence = json.loads(due[at, seq])
            known = chain.facts.get(name)
            since = known.valid_from if known else None
            told = chain.apply(op, name, value, confidence, at)
            closed = told["decision"] == "revise"
            out.append((key[0], seq, told["decision"], told["epoch"], told["closed_value"], told["confidence"], stamp(since if closed else at), stamp(at) if closed else None))
        rest = [tuple(r) for r in rows if (r[0], r[1]) not in due]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(rest)[0])
        else:
            self.waiting.clear()
        for name in before.keys() - chain.facts.keys():
            self.facts.removeKey((name,))
        for name, f in chain.facts.items():
            kept = json.dumps([f.value, f.confidence, f.valid_from, f.epoch])
            if before.get(name) != kept:
                self.facts.updateValue((name,), (kept,))
        self.epoch.update((chain.epoch, last))
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass

    def _epoch(self) -> tuple[int, int | None]:
        return tuple(self.epoch.get()) if self.epoch.exists() else (-1, None)


def fold_in_time(operations: DataFrame, late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """What each operation (chain, seq, ts, op, key, value, confidence) did, as a stream: rows of a chain apply in order of
    ts and seq when the watermark (the latest ts less `late`) has passed them, whatever order they came in. valid_from and valid_to are
    those of the fact that a revision closed; else valid_from is the row's own time. Needs the settings STORE."""
    timed = operations.withWatermark("ts", late)
    return timed.groupBy("chain").transformWithStateInPandas(statefulProcessor=Facts(idle_ms), outputStructType=APPLIED, outputMode="Append", timeMode="EventTime")


class Progress(StreamingQueryListener):
    """How far streams are: rows so far, rows a second of the last batches, state rows, late rows dropped; and the seconds that a
    number of rows will still take."""

    def __init__(self, total: int | None = None, last: int = 5):
        self.total, self.last, self.batches, self.ended = total, last, [], []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators or []
        self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration, "state": sum(s.numRowsTotal for s in states), "late": sum(s.numRowsDroppedByWatermark for s in states)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)

    @property
    def rows(self) -> int:
        return sum(b["rows"] for b in self.batches)

    @property
    def rate(self) -> float:
        """Rows a second over the last batches that had rows."""
        some = [b for b in self.batches if b["rows"]][-self.last :]
        ms = sum(b["ms"] for b in some)
        return 1000 * sum(b["rows"] for b in some) / ms if ms else 0.0

    def remaining(self) -> float | None:
        """Seconds until all rows are read; None where the total or the rate isn't known."""
        return None if self.total is None or not self.rate else max(0, self.total - self.rows) / self.rate
