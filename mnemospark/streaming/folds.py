"""Streams over events: windows, sessions, deduplication, and the fact fold with its state kept by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.functions.lazy import pd
from mnemospark.operators.state import FOLDED, Chain, Fact


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = F.window("ts", size).alias("w")
    return events.withWatermark("ts", late).groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def once(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once; a repeat within the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def fold_stream(operations: DataFrame) -> DataFrame:
    """The batch fold's rows from a stream: state is the chain's current facts as JSON."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = Chain()
        if state.exists:
            facts, chain.epoch = state.get
            chain.facts = {k: Fact(*v) for k, v in json.loads(facts).items()}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [{"chain": key[0], "seq": r.seq} | chain.apply(r.op, r.key, r.value, r.confidence, int(r.seq)) for r in rows.itertuples()]
        state.update((json.dumps({k: [f.value, f.confidence, f.valid_from, f.epoch] for k, f in chain.facts.items()}), chain.epoch))
        yield pd.DataFrame(out, columns=["chain", "seq", "decision", "epoch", "closed_value", "confidence"])

    return operations.groupBy("chain").applyInPandasWithState(step, FOLDED, "facts string, epoch int", "append", GroupStateTimeout.NoTimeout)


def run_to_table(spark: SparkSession, df: DataFrame, mode: str, at: str) -> DataFrame:
    """Runs a stream over what is there now, and reads what it wrote."""
    writer = df.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    query = writer.outputMode(mode).format("parquet").option("path", f"{at}/out").start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")
