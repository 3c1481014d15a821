"""Dialogues cut into windows of bounded tokens, in order, one pass over each dialogue's turns; running sums over any group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.lazy import pd
from mnemospark.functions.shared import stored

PLANNED = "conv_id long, turn long, part int, window_no int, tokens int"


def plan_windows(turns: DataFrame, target: int = 120, hard: int = 200) -> DataFrame:
    """conv_id, turn, part, window_no and tokens: each turn's window, windows from 0 in each dialogue.

    A window ends before the turn that would take it further from the target than it is, a tie going to the smaller,
    and never holds over `hard` tokens: a longer turn is cut into parts. Turns stream by in order, so a dialogue of any
    length needs the same memory. A null text has no tokens.
    """
    words = F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    rows = turns.select("conv_id", "turn", F.size(words).alias("n")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, window, size = None, 0, 0
        for b in batches:
            out = []
            for conv, turn, n in zip(b.conv_id, b.turn, b.n, strict=True):
                if conv != at:
                    at, window, size = conv, 0, 0
                for part, tokens in enumerate([hard] * (n // hard) + [n % hard] * (n % hard > 0 or n == 0)):
                    if size and (size + tokens > hard or abs(size + tokens - target) >= abs(size - target)):
                        window, size = window + 1, 0
                    size += tokens
                    out.append((conv, turn, part, window, tokens))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "part", "window_no", "tokens"])

    return rows.mapInPandas(run, PLANNED)


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over a row and all before it in its group (`by`, all rows if empty), in order.

    Rows are dealt by range of group and order, sums within a range are added to those of the ranges before. So a group of
    any size, or no group at all, needs no task to hold more than its range. Rows must differ in `order` within a group.
    """
    dealt = stored(df.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), before.alias("_before"))
    met = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = F.sum("_value").over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_own", own).join(starts, met).select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))
