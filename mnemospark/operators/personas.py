"""Benchmark data: simulated people whose attributes change month by month, conflicts put among their sessions, questions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.columns import hash_unit
from mnemospark.functions.lazy import pd

#: Attributes, the moves each state allows, and months that an attribute rests after a change.
MOVES = {
    "Marital_Status": {"Single": ["Dating"], "Dating": ["Single", "Married"], "Married": ["Divorced"], "Divorced": ["Dating"]},
    "Work_Status": {"Employed": ["Unemployed", "On_Leave"], "Unemployed": ["Employed"], "On_Leave": ["Employed"]},
    "Health_Status": {"Healthy": ["Recovering"], "Recovering": ["Healthy", "Chronic"], "Chronic": ["Recovering"]},
    "Residence": {"Darwin": ["Melbourne", "Perth"], "Melbourne": ["Perth", "Darwin"], "Perth": ["Darwin", "Melbourne"]},
}
REST = {"Marital_Status": 6, "Work_Status": 2, "Health_Status": 1, "Residence": 3}
HISTORY = "persona long, session int, attribute string, before string, after string"


def calendar(spark: SparkSession, seeds: DataFrame, months: int = 47) -> DataFrame:
    """session and date for each of seeds (persona and other columns, which stay): one session a month from February 2022, its
    day by hash. Planners take the sessions for as few as the seeds; so no join should follow that may broadcast them."""
    at = seeds.select("*", F.posexplode(F.sequence(F.lit("2022-02-01").cast("date"), F.add_months(F.lit("2022-02-01").cast("date"), months - 1), F.expr("INTERVAL 1 MONTH"))).alias("session", "month"))
    return at.select(*seeds.columns, "session", F.date_add("month", F.floor(hash_unit(F.col("persona"), F.col("session"), F.lit("day")) * 28).cast("int")).alias("date"))


def simulate(sessions: DataFrame) -> DataFrame:
    """Changes of each persona's attributes over its sessions: one or two attributes move a session, unless they rest.

    What moves depends on hashes of (persona, session, attribute) alone, so the result is the same however the rows are dealt.
    """
    draws = sessions
    for a in MOVES:
        draws = draws.withColumn(f"u_{a}", hash_unit(F.col("persona"), F.col("session"), F.lit(a))).withColumn(f"w_{a}", hash_unit(F.col("persona"), F.col("session"), F.lit(a), F.lit("to")))
    dealt = draws.repartition("persona").sortWithinPartitions("persona", "session")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, last = None, {}, {}
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if r["persona"] != at:
                    at, state, last = r["persona"], {a: sorted(m)[0] for a, m in MOVES.items()}, {}
                free = [a for a in MOVES if r["session"] - last.get(a, -99) > REST[a]]
                for a in sorted(free, key=lambda a: r[f"u_{a}"])[: 2 if free and min(r[f"u_{a}"] for a in free) < 0.3 else 1]:
                    ways = MOVES[a][state[a]]
                    after = ways[int(r[f"w_{a}"] * len(ways)) % len(ways)]
                    out.append((at, r["session"], a, state[a], after))
                    state[a], last[a] = after, r["session"]
            yield pd.DataFrame(out, columns=["persona", "session", "attribute", "before", "after"])

    return dealt.drop("date").mapInPandas(run, HISTORY)


def static_conflicts(sessions: DataFrame, gap: int = 5) -> DataFrame:
    """For each persona a session that states a fact, a later one, at least `gap` on, that contradicts it, and one between that distracts; all by hash."""
    w = Window.partitionBy("persona")
    s = sessions.select("persona", "session", F.max("session").over(w).alias("last"))
    a = s.where(F.col("session") + gap <= F.col("last")).groupBy("persona", "last").agg(F.min_by("session", hash_unit(F.col("persona"), F.col("session"), F.lit("a"))).alias("point_a"))
    b = s.select("persona", "session").join(a, "persona").where(F.col("session") >= F.col("point_a") + gap).groupBy("persona", "point_a").agg(F.min_by("session", hash_unit(F.col("persona"), F.col("session"), F.lit("b"))).alias("point_b"))
    d = s.select("persona", "session").join(b, "persona").where((F.col("session") > F.col("point_a")) & (F.col("session") < F.col("point_b")))
    return d.groupBy("persona", "point_a", "point_b").agg(F.min_by("session", hash_unit(F.col("persona"), F.col("session"), F.lit("d"))).alias("distractor"))


def questions(history: DataFrame) -> DataFrame:
    """One question for each change: what holds now, its answer, and how many changes of the attribute there were by then."""
    order = Window.partitionBy("persona", "attribute").orderBy("session")
    inside = Window.partitionBy("persona", "session").orderBy("attribute")
    return history.select(
        "persona", "session", F.format_string("Q_%03d", F.row_number().over(inside)).alias("question_id"),
        F.concat(F.lit("What is the user's "), F.lower(F.replace("attribute", F.lit("_"), F.lit(" "))), F.lit(" now?")).alias("question"),
        F.col("after").alias("answer"), F.lit("dynamic_conflict").alias("conflict_type"), F.row_number().over(order).cast("long").alias("changes"),
    )
