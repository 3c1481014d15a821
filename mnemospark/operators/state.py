"""The fold that keeps facts: epochs per chain under add, reinforce, replace and retract, in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.lazy import pd

OPERATIONS = ("add", "reinforce", "replace", "retract")


@dataclass
class Fact:
    value: str
    confidence: float
    valid_from: object
    epoch: int


@dataclass
class Chain:
    """Current facts of one chain by key, and the number of its epoch: -1 before the first."""

    facts: dict[str, Fact] = field(default_factory=dict)
    epoch: int = -1

    def apply(self, op: str, key: str, value: str | None, confidence: float, at: object) -> dict:
        """Applies one operation and tells what it did; one that doesn't fit is told as rejected and changes nothing.

        Adding what is there with an equal value reinforces it. Reinforcing halves the doubt, keeps the epoch and its
        value. Replacing and retracting open a new epoch; the first add opens epoch 0, a later one extends it.
        """
        known = self.facts.get(key)
        if op == "add" and known is not None and known.value == value:
            op = "reinforce"
        if op not in OPERATIONS or (known is None) != (op == "add"):
            return {"decision": "rejected", "epoch": self.epoch, "closed_value": None, "confidence": None}
        if op == "reinforce":
            known.confidence = min(1.0, 1.0 - (1.0 - known.confidence) * 0.5)
            return {"decision": "reinforce", "epoch": self.epoch, "closed_value": None, "confidence": known.confidence}
        closed = known.value if known else None
        decision = "extend" if op == "add" else "revise"
        if decision == "revise" or self.epoch < 0:
            self.epoch += 1
        if op == "retract":
            del self.facts[key]
            return {"decision": decision, "epoch": self.epoch, "closed_value": closed, "confidence": None}
        self.facts[key] = Fact(value, confidence, at, self.epoch)
        return {"decision": decision, "epoch": self.epoch, "closed_value": closed, "confidence": confidence}


FOLDED = "chain long, seq long, decision string, epoch int, closed_value string, confidence double"


def fold(operations: DataFrame) -> DataFrame:
    """What each operation (chain, seq, op, key, value, confidence) did, per chain in order of seq.

    The rows of a chain stream through in order; only its current facts are held, so a long chain needs no more
    memory than a short one.
    """
    dealt = operations.repartition("chain").sortWithinPartitions("chain", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, Chain()
        for b in batches:
            out = []
            for chain, seq, op, key, value, confidence in zip(*(b[c] for c in ("chain", "seq", "op", "key", "value", "confidence")), strict=True):
                if chain != at:
                    at, state = chain, Chain()
                out.append({"chain": chain, "seq": seq} | state.apply(op, key, value, confidence, seq))
            yield pd.DataFrame(out, columns=["chain", "seq", "decision", "epoch", "closed_value", "confidence"])

    return dealt.select("chain", "seq", "op", "key", "value", "confidence").mapInPandas(run, FOLDED)


def reduced(events: DataFrame) -> DataFrame:
    """Operations from claims (chain, seq, key, value): new keys are added, equal values reinforced, others replaced.

    This is the deterministic reducer that stands in for a model: a window compares each claim with the one before.
    """
    from pyspark.sql.window import Window

    before = F.lag("value").over(Window.partitionBy("chain", "key").orderBy("seq"))
    op = F.when(before.isNull(), "add").when(before == F.col("value"), "reinforce").otherwise("replace")
    return events.withColumn("op", op)
