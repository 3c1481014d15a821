"""Queries that build: graphs, windows, selections, benchmark data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import graph as G
from mnemospark.operators import pairs as PR
from mnemospark.operators import personas as P
from mnemospark.operators import search as S
from mnemospark.operators import selection as SEL
from mnemospark.operators import windows as W

from .registry import query, table
from .search import _CENTRES, _COSINE, _centres, _vectors

_EDGES = """
e AS (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target, event_type, value FROM events),
edges AS (SELECT source, target, CASE source % 3 WHEN 0 THEN 'TEMPORAL_NEXT' WHEN 1 THEN 'CAUSES' ELSE 'SAME_EVENT' END AS type, CASE source % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'derived' END AS trust, (source % 10) / 10.0 AS confidence FROM e WHERE target IS NOT NULL),
best AS (SELECT s AS source, t AS target, type, max((trust = 'explicit', confidence, trust)) AS b FROM (SELECT CASE WHEN type = 'SAME_EVENT' THEN least(source, target) ELSE source END AS s, CASE WHEN type = 'SAME_EVENT' THEN greatest(source, target) ELSE target END AS t, type, trust, confidence FROM edges) GROUP BY 1, 2, 3)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("source") % n + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("source"), nxt.alias("target")).where("target IS NOT NULL")
    return e.select("source", "target", pick(3, "TEMPORAL_NEXT", "CAUSES", "SAME_EVENT").alias("type"), pick(4, "explicit", "inferred", "derived", "derived").alias("trust"), ((F.col("source") % 10) / 10.0).alias("confidence"))


@query(f"WITH {_EDGES} SELECT type, struct_extract_at(b, 3) AS trust, count(*) AS edges, CAST(sum(source) AS BIGINT) AS sources, CAST(sum(target) AS BIGINT) AS targets FROM best GROUP BY 1, 2")
def oriented_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.oriented(_edges(spark, sf_dir)).groupBy("type", "trust").agg(F.count("*").alias("edges"), F.sum("source").alias("sources"), F.sum("target").alias("targets"))


@query(f"""
WITH {_EDGES}, ed AS (SELECT source, target, type, struct_extract_at(b, 3) AS trust, struct_extract_at(b, 2) AS confidence FROM best),
hop AS (SELECT source AS anchor, target AS node, type, trust FROM ed WHERE trust <> 'derived' OR confidence >= 0.5 UNION ALL SELECT target, source, type, trust FROM ed WHERE trust <> 'derived' OR confidence >= 0.5),
a AS (SELECT user_id AS probe, event_id AS anchor, value / 100.0 AS score FROM events),
s AS (SELECT probe, anchor, node, type, round(0.8 * score * CASE trust WHEN 'explicit' THEN 1.0 WHEN 'inferred' THEN 0.78 ELSE 0.42 END * CASE type WHEN 'CAUSES' THEN 1.0 WHEN 'SAME_EVENT' THEN 0.95 ELSE 0.65 END + 0.2 * (node % 7) / 7.0, 6) AS score FROM a JOIN hop USING (anchor)),
m AS (SELECT probe, anchor, node, max((score, type)) AS b FROM s GROUP BY 1, 2, 3),
o AS (SELECT probe, anchor, node, struct_extract_at(b, 1) AS score, struct_extract_at(b, 2) AS type FROM m)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe, anchor ORDER BY score DESC, node) AS rank FROM o) WHERE rank <= 2
""")
def expand_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an anchor: its two best neighbours."""
    ev = table(spark, sf_dir, "events")
    anchors = ev.select(F.col("user_id").alias("probe"), F.col("event_id").alias("anchor"), (F.col("value") / 100.0).alias("score"))
    rel = ev.select(F.col("user_id").alias("probe"), F.col("event_id").alias("node"), ((F.col("event_id") % 7) / 7.0).alias("rel"))
    return G.expand(anchors, G.oriented(_edges(spark, sf_dir)), rel, 2)


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 500 AS b FROM orders), pairs AS (SELECT a * 2 AS a, b * 2 + 1 AS b FROM p),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT reach.id, b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT id, min(r) AS canonical FROM reach GROUP BY id
""")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities merged through chains of pairs."""
    o = table(spark, sf_dir, "orders")
    return G.merged(o.select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") % 500 * 2 + 1).alias("b")).distinct())


@query("""
WITH d AS (SELECT event_id AS id, user_id AS chain, event_type AS action, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id % 10 AS topic, CAST(ts AS DATE) AS session FROM events),
p AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.k = b.k AND a.action = b.action THEN 'SAME_EVENT'
  WHEN a.topic = b.topic AND a.session <> b.session AND abs(a.start - b.start) <= 604800 THEN 'FOLLOW_UP_OF' WHEN a.k = b.k AND a.chain <> b.chain THEN 'CONTEXT_FOR' END AS type
 FROM d a JOIN d b ON a.id < b.id AND (a.k = b.k OR a.topic = b.topic))
SELECT type, count(*) AS pairs, min(a) AS first, max(b) AS last FROM p WHERE type IS NOT NULL GROUP BY 1
""")
def cross_edge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of all events, on any two days."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return G.related(e.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("action"), (F.col("user_id") % 10).alias("topic"), F.col("user_id").alias("chain"), F.datediff(day, F.lit("1970-01-01")).alias("day"), (start - F.unix_seconds(day.cast("timestamp"))).alias("second")))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.dense(_centres(spark, sf_dir), v, 32).drop("rank").join(v.select("id", "v", F.col("label").alias("topic")), "id").select("probe", "id", "score", "topic", (F.col("id") % 3).alias("kind"), (F.col("id") % 5).alias("importance"), "v")


@query()
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.diverse(_candidates(spark, sf_dir), 12)


@query()
def coverage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).select("probe", "id", "score", F.col("kind").alias("need"), (F.col("importance") == 4).alias("protected"))
    return SEL.covering(c, 8)


@query(f"""
WITH {_CENTRES}, s AS (SELECT probe, vec_id AS id, embedding, round({_COSINE}, 6) AS score FROM embeddings, centre),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS r FROM s) WHERE r <= 32),
near AS (SELECT a.probe, a.id FROM top a JOIN top b ON a.probe = b.probe AND b.r < a.r
 WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) > 0.95)
SELECT probe, id, score, CAST(row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS INT) AS rank FROM top WHERE (probe, id) NOT IN (SELECT (probe, id) FROM near)
""")
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.deduplicated(_candidates(spark, sf_dir).select("probe", "id", "score", "v")).drop("merged")


@query()
def window_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.plan_windows(table(spark, sf_dir, "conversations"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("persona"))


@query()
def persona_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.simulate(P.calendar(spark, _seeds(spark, sf_dir)))


@query()
def questions_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.questions(P.simulate(P.calendar(spark, _seeds(spark, sf_dir))))


_UNIT = "CAST(('0x' || substr(sha256(concat_ws('|', {})), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(f"""
WITH s AS (SELECT s_suppkey AS persona, session FROM supplier, (SELECT unnest(range(47)) AS session)),
a AS (SELECT persona, min_by(session, {_UNIT.format("persona::VARCHAR, session::VARCHAR, 'a'")}) AS point_a FROM s WHERE session + 5 <= 46 GROUP BY 1),
b AS (SELECT persona, point_a, min_by(session, {_UNIT.format("persona::VARCHAR, session::VARCHAR, 'b'")}) AS point_b FROM s JOIN a USING (persona) WHERE session >= point_a + 5 GROUP BY 1, 2)
SELECT persona, point_a, point_b, min_by(session, {_UNIT.format("persona::VARCHAR, session::VARCHAR, 'd'")}) AS distractor FROM s JOIN b USING (persona) WHERE session > point_a AND session < point_b GROUP BY 1, 2, 3
""")
def distractor_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contradicting sessions of each persona and a distracting one between."""
    return P.static_conflicts(P.calendar(spark, _seeds(spark, sf_dir)))


@query("""
WITH m AS (SELECT user_id, CAST(ts AS DATE) AS session, event_type, value FROM events)
SELECT user_id, session, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN bool_or(event_type = 'purchase') THEN 'static' END, CASE WHEN bool_or(value > 90) THEN 'conditional' END, CASE WHEN count(DISTINCT event_type) > 2 THEN 'dynamic' END], lambda x: x IS NOT NULL))), ',') AS triggers FROM m GROUP BY 1, 2
""")
def trigger_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of question each session's events call for."""
    m = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("session"))
    flags = m.agg(F.bool_or(F.col("event_type") == "purchase").alias("s"), F.bool_or(F.col("value") > 90).alias("c"), (F.countDistinct("event_type") > 2).alias("d"))
    kinds = F.array_compact(F.array(F.when(F.col("c"), "conditional"), F.when(F.col("d"), "dynamic"), F.when(F.col("s"), "static")))
    return flags.select("user_id", "session", F.array_join(kinds, ",").alias("triggers"))


#: Orders as events: their parts (of 500) are entities, their priority the action, and what they are numbered the session.
_ORDER_EVENTS = """
tok AS (SELECT l_orderkey AS id, list_sort(list_distinct(list('p' || (l_partkey % 500)))) AS e FROM lineitem GROUP BY 1),
ev AS (SELECT o_orderkey AS id, o_custkey % {scopes} AS scope, 'c' || (o_custkey % 7) AS chain, lower(o_orderpriority) AS action, o_orderstatus || (o_custkey % 9) AS topic, e, 'kind' || (o_custkey % 3) || ' state' || o_orderstatus AS title, o_orderdate AS at, 's' || (o_orderkey % 1000) AS session, 'p' || (o_orderkey % 3) AS speaker FROM orders JOIN tok ON id = o_orderkey),
part AS (SELECT scope, list(DISTINCT speaker) AS people FROM ev GROUP BY 1), each AS (SELECT id, scope, unnest(e) AS m FROM ev),
met AS (SELECT DISTINCT a.id AS a, b.id AS b FROM each a JOIN each b ON a.m = b.m AND a.id < b.id AND {meet} UNION SELECT a.id, b.id FROM ev a JOIN ev b ON a.topic = b.topic AND a.id < b.id AND {meet} AND abs(epoch(a.at) - epoch(b.at)) <= 604800),
p AS (SELECT a.id AS a, b.id AS b, a.at AS sa, b.at AS sb, len(list_intersect(a.e, b.e)) / len(list_distinct(a.e || b.e)) AS j, a.action = b.action AS same, abs(epoch(a.at) - epoch(b.at)) AS gap, a.title AS ta, b.title AS tb, a.topic = b.topic AS topic, a.session <> b.session AS apart, a.chain <> b.chain AS chains
  FROM met JOIN ev a ON a.id = met.a JOIN ev b ON b.id = met.b JOIN part pa ON pa.scope = a.scope JOIN part pb ON pb.scope = b.scope WHERE {seen}),
k AS (SELECT *, CASE WHEN same AND gap <= 86400 AND j >= 0.6 THEN 'action, time and entities' WHEN same AND gap > 86400 AND j >= 0.75 THEN 'action and entities'
  WHEN NOT same AND j >= 0.75 AND ta = tb THEN 'title and entities' WHEN topic AND apart AND gap <= 604800 THEN 'topic and time' WHEN chains AND j > 0 THEN 'entity' END AS signal FROM p)
SELECT CASE WHEN signal = 'topic and time' AND sb > sa THEN b ELSE a END AS source, CASE WHEN signal = 'topic and time' AND sb > sa THEN a ELSE b END AS target, CASE signal WHEN 'topic and time' THEN 'FOLLOW_UP_OF' WHEN 'entity' THEN 'CONTEXT_FOR' ELSE 'SAME_EVENT' END AS type, signal FROM k WHERE signal IS NOT NULL
"""


def _order_events(spark: SparkSession, sf_dir: str, scopes: int) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey") % 500)).alias("entities"))
    c = F.col("o_custkey")
    title = F.concat(F.lit("kind"), c % 3, F.lit(" state"), F.col("o_orderstatus"))
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (c % scopes).alias("scope"), F.concat(F.lit("c"), c % 7).alias("chain"), F.col("o_orderpriority").alias("action"), F.concat("o_orderstatus", c % 9).alias("topic"), title.alias("title"), F.col("o_orderdate").cast("timestamp").alias("starts"), F.array(F.concat(F.lit("s"), F.col("o_orderkey") % 1000)).alias("sessions"), F.array(F.concat(F.lit("p"), F.col("o_orderkey") % 3)).alias("speakers"))
    return at.withColumn("ends", F.col("starts")).join(parts, "id")


@query("WITH " + _ORDER_EVENTS.format(scopes=20, meet="a.scope = b.scope", seen="TRUE"))
def event_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a scope's events that may be related, with type and signal."""
    return PR.event_pairs(_order_events(spark, sf_dir, 20))


@query("WITH " + _ORDER_EVENTS.format(scopes=40, meet="a.scope <> b.scope", seen="list_contains(pb.people, a.speaker) AND list_contains(pa.people, b.speaker)") + " AND signal <> 'entity'")
def cross_scope_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events of two scopes that see each other: the same event, or one that follows the other."""
    e = _order_events(spark, sf_dir, 40)
    people = e.groupBy("scope").agg(F.array_distinct(F.flatten(F.collect_set("speakers"))).alias("participants"))
    return PR.event_pairs(e, people, context=False)
