"""Ordered computations: timeline edges, sessions, atoms, gaps, running costs, choices of one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators.search import ranked

from .registry import query, table


@query("""
SELECT user_id AS chain, event_id AS source, lead(event_id) OVER w AS target, row_number() OVER w = 1 AS is_first, lead(event_id) OVER w IS NULL AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def temporal_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = F.lead("event_id").over(w)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("source"), nxt.alias("target"), (F.row_number().over(w) == 1).alias("is_first"), nxt.isNull().alias("is_last"))


@query("""
WITH e AS (SELECT user_id, event_type, event_id, value, lag(value) OVER w AS before, lead(event_id) OVER w AS nxt, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
x AS (SELECT user_id, event_type, event_id AS node, 'INITIAL_STATE' AS edge, NULL::BIGINT AS target FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_type, event_id, 'CURRENT_STATE', NULL FROM e WHERE nxt IS NULL
  UNION ALL SELECT user_id, event_type, event_id, 'SEMANTIC_NEXT', nxt FROM e WHERE nxt IS NOT NULL)
SELECT * FROM x
""")
def state_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, current and next state of each chain: all three from one window."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("node"), F.lead("event_id").over(w).alias("nxt"), F.row_number().over(w).alias("n"))
    edge = lambda when, name, target: F.when(when, F.struct(F.lit(name).alias("edge"), target.alias("target")))
    none = F.lit(None).cast("long")
    all_edges = F.array_compact(F.array(edge(F.col("n") == 1, "INITIAL_STATE", none), edge(F.col("nxt").isNull(), "CURRENT_STATE", none), edge(F.col("nxt").isNotNull(), "SEMANTIC_NEXT", F.col("nxt"))))
    return e.select("user_id", "event_type", "node", F.inline(all_edges))


@query("""
WITH r AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT user_id AS chain, min(ts) AS first_time, max(ts) AS last_time, count(*) AS members, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS entities,
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 6) AS top_members FROM r GROUP BY user_id
""")
def chain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    chains = e.groupBy(F.col("user_id").alias("chain")).agg(F.min("ts").alias("first_time"), F.max("ts").alias("last_time"), F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("entities"))
    top = ranked(e, ["user_id"], [F.desc("value"), F.col("event_id")], 6).groupBy(F.col("user_id").alias("chain")).agg(F.sort_array(F.collect_list(F.struct("rank", "event_id"))).alias("t"))
    return chains.join(top.select("chain", F.array_join(F.transform("t", lambda x: x["event_id"].cast("string")), ",").alias("top_members")), "chain")


@query("""
WITH e AS (SELECT user_id, event_type AS edge, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_id, value FROM events),
x AS (SELECT *, CASE WHEN prev = edge THEN 'same' ELSE 'other' END AS direction, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END AS trust FROM e)
SELECT direction, edge, count(*) AS options, min_by(event_id, (trust, -value, event_id)) AS best FROM x GROUP BY 1, 2
""")
def nav_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best option of each direction and kind: trust first, then confidence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").withColumn("direction", F.when(F.lag("event_type").over(w) == F.col("event_type"), "same").otherwise("other"))
    trust = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 2).otherwise(3)
    return x.groupBy("direction", F.col("event_type").alias("edge")).agg(F.count("*").alias("options"), F.min_by("event_id", F.struct(trust, -F.col("value"), "event_id")).alias("best"))


@query("""
WITH t AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS atom FROM conversations)
SELECT conv_id, atom, count(*) AS turns, min(turn) AS first_turn, CAST(sum(len(string_split_regex(trim(text), '\\s+'))) AS BIGINT) AS tokens FROM t GROUP BY conv_id, atom
""".replace("\\\\", "\\"))
def dialogue_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialogue cut anew at each of the user's turns."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    t = table(spark, sf_dir, "conversations").withColumn("atom", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    return t.groupBy("conv_id", "atom").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("tokens"))


@query("""
WITH h AS (SELECT user_id, CAST(ts AS DATE) AS m FROM events GROUP BY 1, 2),
i AS (SELECT user_id, m, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m) - 1 AS BIGINT) AS session, date_diff('day', DATE '2000-01-01', m) AS k FROM h)
SELECT user_id, session AS left_session, nxt AS right_session, CAST(gap - 1 AS BIGINT) AS between_sessions FROM (
  SELECT user_id, session, lead(session) OVER w AS nxt, lead(k) OVER w - k AS gap FROM i WINDOW w AS (PARTITION BY user_id ORDER BY session)) WHERE gap > 1
""")
def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between a user's neighbouring active days: where a distractor fits."""
    w = Window.partitionBy("user_id").orderBy("m")
    at = F.to_date("ts")
    i = table(spark, sf_dir, "events").select("user_id", at.alias("m")).distinct().select("user_id", "m", (F.row_number().over(w) - 1).cast("long").alias("session"), F.datediff("m", F.lit("2000-01-01").cast("date")).alias("k"))
    v = Window.partitionBy("user_id").orderBy("session")
    g = i.select("user_id", F.col("session").alias("left_session"), F.lead("session").over(v).alias("right_session"), (F.lead("k").over(v) - F.col("k") - 1).cast("long").alias("between_sessions"))
    return g.where("between_sessions > 0")


@query("""
SELECT conv_id, CAST(row_number() OVER (ORDER BY first_turn, md5) - 1 AS BIGINT) AS session FROM (
  SELECT conv_id, CASE WHEN max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS first_turn, substr(sha256(CAST(conv_id AS VARCHAR)), 1, 24) AS md5 FROM conversations GROUP BY conv_id)
""")
def renumber_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 0 over all conversations, those with a system turn first. Counts of a hash's first digits give each
    row its number without one task holding all rows."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(F.max(F.when(F.col("role") == "system", 1).otherwise(0)) == 1, 0).otherwise(1).alias("late"))
    c = c.withColumn("h", F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 24)).withColumn("cell", F.substring("h", 1, 2))
    cells = c.groupBy("late", "cell").agg(F.count("*").alias("n"))  # 512 rows at most
    before = cells.select("late", "cell", F.coalesce(F.sum("n").over(Window.orderBy("late", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("late", "cell").orderBy("h"))
    return c.withColumn("place", inside).join(F.broadcast(before), ["late", "cell"]).select("conv_id", (F.col("before") + F.col("place") - 1).cast("long").alias("session"))


@query("""
SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn DESC) AS r FROM conversations) WHERE r = 1
""")
def latest_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest record of each key, the later of equals: one aggregate, no sort of groups."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.struct(F.length("text"), "turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")


@query("""
SELECT l_suppkey AS provider, l_orderkey AS call, l_linenumber AS line, round(sum(round(l_quantity * 0.15 / 1e3, 6)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING), 6) AS cost FROM lineitem
""")
def cumulative_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    price = F.round(F.col("l_quantity") * 0.15 / 1e3, 6)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("provider"), F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("line"), F.round(F.sum(price).over(w), 6).alias("cost"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n
""")
def sessionize_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY 1, 2")
def tumbling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 hour").alias("w")
    return table(spark, sf_dir, "events").groupBy("event_type", w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("v")).select("event_type", F.col("w.start").alias("start"), "n", "v")


@query("""
SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i FOR i IN range(4)]) AS start FROM events) GROUP BY 1, 2
""")
def sliding_1h_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 hour", "15 minutes").alias("w")
    return table(spark, sf_dir, "events").groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("""
WITH s AS (SELECT user_id, event_id, value AS x, max(value) OVER w AS hi, min(value) OVER w AS lo FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, event_id, round(CASE WHEN hi - lo <= 1e-12 THEN 0 ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM s
""")
def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.when(hi - lo <= 1e-12, 0.0).otherwise((F.col("value") - lo) / (hi - lo)), 6).alias("scaled"))
