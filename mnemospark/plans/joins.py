"""Joins on keys and on time: orders and line items are an entity bridge and intervals, events are timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import temporal as T

from .registry import query, table


@query("""
WITH parts AS (SELECT l_suppkey, l_partkey FROM lineitem), want AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3)
SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS n FROM parts SEMI JOIN want ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_partkey) = 3
""")
def entity_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that shipped every one of the three dearest parts (a top-3 report)."""
    want = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select(F.col("p_partkey").alias("l_partkey"))
    found = table(spark, sf_dir, "lineitem").join(F.broadcast(want), "l_partkey", "left_semi").groupBy(F.col("l_suppkey").alias("s")).agg(F.countDistinct("l_partkey").alias("n"))
    return found.where("n = 3")


@query("""
WITH want AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20)
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM want))
""")
def entity_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with any of the twenty dearest parts."""
    want = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").join(F.broadcast(want), "l_partkey", "left_semi")
    return table(spark, sf_dir, "orders").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""
SELECT DISTINCT c.n_name AS nation, s.s_suppkey AS supplier FROM (SELECT DISTINCT c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) c JOIN supplier s ON s.s_nationkey = c.c_nationkey
""")
def scopes_by_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations (scopes) and suppliers (participants) that share one: distinct join over the bridge."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    named = c.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation")), "k")
    return named.join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("supplier")), "k").select("nation", "supplier").distinct()


@query("""
SELECT l_orderkey AS node, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS evidence FROM lineitem GROUP BY 1
""")
def evidence_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.count("*").alias("n"), own.alias("e"))
    return df.select("node", "n", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("evidence"))



@query(f"""
WITH types AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events),
x AS (SELECT user_id, event_id AS id, ts AS s, ts + INTERVAL 2 HOUR AS e, event_type FROM events)
SELECT l.user_id, l.id AS left_id, r.id AS right_id FROM x l JOIN x r ON l.user_id = r.user_id AND l.s <= r.e AND r.s <= l.e, types WHERE l.event_type = a AND r.event_type = b
""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour spans of one kind of event that meet a span of another kind of the same user."""
    ev = table(spark, sf_dir, "events")
    kinds = ev.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    span = lambda kind, x: ev.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("left_id" if x == "l" else "right_id"), F.col("ts").alias(f"{x}s"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias(f"{x}e"))
    return T.overlapping(span(kinds["a"], "l"), span(kinds["b"], "r"), ["user_id"]).select("user_id", "left_id", "right_id")


def _around(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Anchors are a user's events of the last kind by name, rows its events of the first kind."""
    ev = table(spark, sf_dir, "events")
    kinds = ev.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    anchors = ev.where(F.col("event_type") == kinds["b"]).select("user_id", F.col("event_id").alias("anchor"), F.col("ts").alias("at"))
    rows = ev.where(F.col("event_type") == kinds["a"]).select("user_id", F.col("event_id").alias("id"), "ts")
    return T.neighbours(anchors, rows, ["user_id"], 3, side)


_AROUND = """
WITH types AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events),
anchors AS (SELECT user_id, event_id AS anchor, ts AS moment FROM events, types WHERE event_type = b),
found AS (SELECT user_id, anchor, event_id AS id, abs(epoch_us(ts) - epoch_us(moment)) AS gap_us FROM anchors JOIN events USING (user_id), types WHERE event_type = a {})
SELECT * FROM (SELECT user_id, anchor, id, gap_us, row_number() OVER (PARTITION BY user_id, anchor ORDER BY gap_us, id) AS rank FROM found) WHERE rank <= 3
"""


@query(_AROUND.format("AND ts <= moment"))
def before_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "before")


@query(_AROUND.format("AND ts > moment"))
def after_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "after")


@query(_AROUND.format(""))
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "nearest")


@query("""
WITH f AS (SELECT user_id, event_type, event_id, value, ts AS valid_from, lead(ts) OVER w AS valid_to, CAST(row_number() OVER w - 1 AS BIGINT) AS epoch FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, event_type, event_id, epoch, round(value, 6) AS value, valid_from, valid_to, valid_to IS NULL AS is_current FROM f
""")
def scd2_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("id", F.col("event_id"))
    df = T.validity(ev, ["user_id", "event_type"])
    return df.select("user_id", "event_type", "event_id", "epoch", F.round("value", 6).alias("value"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


@query("""
WITH f AS (SELECT user_id, event_type, event_id, ts AS vf, coalesce(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), TIMESTAMP '9999-12-31') AS vt FROM events),
b AS (SELECT user_id, median(epoch_us(ts)) AS m FROM events GROUP BY user_id)
SELECT f.user_id, event_type, event_id FROM f JOIN b USING (user_id) WHERE epoch_us(vf) <= m AND m < epoch_us(vt)
""")
def as_of_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of each kind that held at the middle moment of its user's timeline."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ev = table(spark, sf_dir, "events").withColumn("id", F.col("event_id"))
    middle = ev.groupBy("user_id").agg(F.percentile(micros("ts"), 0.5).alias("m"))
    facts = T.validity(ev, ["user_id", "event_type"]).join(middle, "user_id")
    return facts.where((micros("valid_from") <= F.col("m")) & (F.col("valid_to").isNull() | (F.col("m") < micros("valid_to")))).select("user_id", "event_type", "event_id")


@query("""
WITH e AS (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
ok AS (SELECT * FROM e WHERE target IS NOT NULL)
SELECT source AS node, target AS neighbour, 'out' AS direction FROM ok UNION ALL SELECT target, source, 'in' FROM ok
""")
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of every edge of the timeline graph: two projections of one scan in place of a join on either end."""
    edges = table(spark, sf_dir, "events").select(F.col("event_id").alias("source"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("target")).where("target IS NOT NULL")
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbour"), F.lit("out").alias("direction")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbour"), F.lit("in").alias("direction")))
    return edges.select(F.inline(ends))


@query("""
WITH p AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS people, list_sort(list_distinct(list(role) FILTER (turn > 0))) AS seen FROM conversations GROUP BY conv_id),
g AS (SELECT people, coalesce(seen, []) AS seen, count(*) AS n FROM p GROUP BY ALL)
SELECT array_to_string(a.people, ',') AS left_people, array_to_string(b.people, ',') AS right_people, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM g a, g b
WHERE len(a.seen) > 0 AND len(b.seen) > 0 AND len(list_intersect(a.seen, b.people)) = len(a.seen) AND len(list_intersect(b.seen, a.people)) = len(b.seen) GROUP BY 1, 2
""")
def visibility_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations that may see each other: each one's evidence is by the other's participants; none without evidence.

    Conversations with the same people and evidence are counted as one class first, so pairs of classes meet, not of rows.
    """
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("people"), F.sort_array(F.collect_set(F.when(F.col("turn") > 0, F.col("role")))).alias("seen"))
    kinds = own.groupBy("people", "seen").agg(F.count("*").alias("n"))
    a, b = (kinds.select(*(F.col(c).alias(f"{c}_{x}") for c in ("people", "seen", "n"))).where(F.size(f"seen_{x}") > 0) for x in "ab")
    sees = (F.size(F.array_except("seen_a", "people_b")) == 0) & (F.size(F.array_except("seen_b", "people_a")) == 0)
    met = a.select("*", F.explode("seen_a").alias("who")).join(b.select("*", F.explode("people_b").alias("who")), "who").where(sees).drop("who").distinct()
    return met.groupBy(F.array_join("people_a", ",").alias("left_people"), F.array_join("people_b", ",").alias("right_people")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"))


@query("""
SELECT o_orderkey AS checkpoint, o_custkey AS scope FROM orders o WHERE EXISTS (SELECT 1 FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderdate > o.o_orderdate)
""")
def stale_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints older than their scope's newest revision: one aggregate a scope in place of a self-join."""
    newest = Window.partitionBy("o_custkey")
    df = table(spark, sf_dir, "orders").withColumn("newest", F.max("o_orderdate").over(newest))
    return df.where("o_orderdate < newest").select(F.col("o_orderkey").alias("checkpoint"), F.col("o_custkey").alias("scope"))


@query("""
SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id
""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that never got a system turn: the data set less what was seen."""
    c = table(spark, sf_dir, "conversations")
    return c.join(c.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))


@query("""
WITH d AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT a.o_orderkey AS point_b, b.o_orderkey AS point_a, CAST(a.day - b.day AS BIGINT) AS gap_days FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND b.n = a.n - 1
""")
def previous_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with the one before it in its chain: lag in place of a self-join on rank - 1."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_b"), F.lag("o_orderkey").over(order).alias("point_a"), F.datediff("o_orderdate", F.lag("o_orderdate").over(order)).cast("long").alias("gap_days"))
    return df.where("point_a IS NOT NULL")
