"""Queries that move between nodes: events are nodes, their users spaces, their types scopes, and each user's latest event an anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.shared import stored
from mnemospark.operators import graph as G
from mnemospark.operators import intents as I
from mnemospark.operators import navigation as N
from mnemospark.operators import runtime as R
from mnemospark.operators import selection as SEL

from .construction import _EDGES, _edges
from .intents import _found
from .registry import query, table

_NODES = """
raw AS (SELECT event_id AS id, user_id AS space, event_type AS scope, CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'semantic_state' ELSE 'chain_head' END AS kind, ts AS starts, CASE WHEN event_id % 4 > 0 THEN ts + to_hours(event_id % 4) END AS ends,
  event_id % 7 > 0 AS reliable, [event_type, 'k' || json_extract_string(props, '$.k')] AS entities, (event_id % 10) / 10.0 AS confidence, 'p' || (event_id % 3) AS speaker FROM events),
n AS (SELECT * EXCLUDE speaker, [speaker] AS evidence, list_distinct(list(speaker) OVER (PARTITION BY space, scope)) AS members FROM raw)
"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id").alias("space"), F.col("event_type").alias("scope"), F.when(i % 3 == 0, "event").when(i % 3 == 1, "semantic_state").otherwise("chain_head").alias("kind"), F.col("ts").alias("starts"),
        F.when(i % 4 > 0, F.col("ts") + F.make_dt_interval(hours=(i % 4).cast("int"))).alias("ends"), (i % 7 > 0).alias("reliable"), F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("entities"),
        ((i % 10) / 10.0).alias("confidence"), F.array("event_type").alias("words"), F.array(F.concat(F.lit("p"), (i % 3).cast("string"))).alias("evidence"),
    )
    members = e.groupBy("space", "scope").agg(F.array_distinct(F.flatten(F.collect_set("evidence"))).alias("members"))
    return e.withColumn("entity_ids", F.col("entities")).join(members, ["space", "scope"])


@query(f"""
WITH {_NODES}, top AS (SELECT space, max_by(id, (starts, id)) AS id FROM n WHERE kind = 'event' GROUP BY 1),
a AS (SELECT n.*, unnest(['ENTITY_LOOKUP', 'CROSS_ENTITY_LOOKUP', 'TIME_OVERLAP_LOOKUP', 'TEMPORAL_BEFORE_LOOKUP', 'TEMPORAL_AFTER_LOOKUP', 'NEAREST_TIME_LOOKUP']) AS action FROM n JOIN top USING (space, id)),
x AS (SELECT a.id AS anchor, a.action, a.scope AS a_scope, a.starts AS a_starts, a.ends AS a_ends, a.entities AS a_entities, a.evidence AS a_evidence, a.members AS a_members, n.*, coalesce(n.ends, n.starts) AS last, coalesce(a.ends, a.starts) AS a_last FROM a JOIN n USING (space) WHERE n.kind <> 'chain_head'),
y AS (SELECT *, CASE WHEN action = 'NEAREST_TIME_LOOKUP' THEN greatest(0, epoch_us(a_starts) - epoch_us(last), epoch_us(starts) - epoch_us(a_starts)) WHEN action = 'TEMPORAL_BEFORE_LOOKUP' THEN -epoch_us(last) WHEN action = 'TEMPORAL_AFTER_LOOKUP' THEN epoch_us(starts) ELSE 0 END AS far,
  CASE WHEN action IN ('TEMPORAL_BEFORE_LOOKUP', 'TEMPORAL_AFTER_LOOKUP', 'NEAREST_TIME_LOOKUP') THEN '' ELSE scope END AS first, CASE WHEN action IN ('TEMPORAL_BEFORE_LOOKUP', 'TEMPORAL_AFTER_LOOKUP') THEN 0 ELSE epoch_us(starts) END AS begins FROM x
  WHERE CASE action WHEN 'ENTITY_LOOKUP' THEN list_has_any(entities, a_entities) WHEN 'CROSS_ENTITY_LOOKUP' THEN kind = 'event' AND list_has_all(entities, a_entities) WHEN 'TIME_OVERLAP_LOOKUP' THEN kind = 'event' AND reliable AND a_ends IS NOT NULL AND starts <= a_ends AND last >= a_starts
    WHEN 'TEMPORAL_BEFORE_LOOKUP' THEN kind = 'event' AND reliable AND last < a_starts WHEN 'TEMPORAL_AFTER_LOOKUP' THEN kind = 'event' AND reliable AND starts > a_last ELSE kind = 'event' AND reliable END),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor, action ORDER BY far, first, begins, id) AS m FROM y) WHERE m <= CASE action WHEN 'ENTITY_LOOKUP' THEN 6 ELSE 12 END AND id <> anchor
  AND (a_scope = scope OR (list_has_all(members, a_evidence) AND list_has_all(a_members, evidence)))),
s AS (SELECT anchor, action, id, round(0.40 * CASE WHEN a_scope = scope THEN 0.25 ELSE 0 END + 0.25 * len(list_intersect(a_entities, entities)) / 2 + 0.20 * CASE WHEN action LIKE '%ENTITY%' THEN 0 ELSE 1 / (1 + greatest(0, epoch_us(a_starts) - epoch_us(last), epoch_us(starts) - epoch_us(a_last)) / 1e6 / 86400.0 / 30.0) END
  + 0.10 * confidence + 0.05 * CASE action WHEN 'ENTITY_LOOKUP' THEN 0.65 WHEN 'TIME_OVERLAP_LOOKUP' THEN 0.85 WHEN 'NEAREST_TIME_LOOKUP' THEN 0.70 ELSE 0.80 END, 6) AS score FROM z)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor, action ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3
""")
def virtual_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lookups by entities and in time from each user's latest event: what is read, seen, scored and kept."""
    nodes = stored(_nodes(spark, sf_dir))
    top = nodes.where("kind = 'event'").groupBy("space").agg(F.max(F.struct("starts", "id", "scope")).alias("t"))
    actions = [a for a in R.LOOKUP_PRIOR]
    anchors = top.select(F.col("t.id").alias("anchor"), F.explode(F.array(*map(F.lit, actions))).alias("action"), F.lit(3).alias("budget"), F.concat(F.lit("what of "), F.col("t.scope"), F.lit(" now")).alias("question"))
    return N.lookups(anchors, nodes)


@query("""
WITH r AS (SELECT conv_id AS anchor, turn, text, regexp_extract_all(lower('source evidence turn ' || turn || ' ' || text), '[\\p{L}\\p{N}_'']+') AS w FROM conversations WHERE trim(coalesce(text, '')) <> ''),
q AS (SELECT conv_id AS anchor, list_distinct(regexp_extract_all(lower(min_by(text, turn)), '[\\p{L}\\p{N}_'']+')) AS q FROM conversations GROUP BY 1),
s AS (SELECT anchor, 'source_evidence_' || left(sha256(anchor || '␟' || anchor || '-' || turn), 24) AS id, anchor || '-' || turn AS record, round(least(1.0, 0.6 + 0.4 * CASE WHEN len(q) = 0 THEN 0.85 ELSE len(list_intersect(q, list_distinct(w))) / len(q) END), 6) AS score FROM r JOIN q USING (anchor))
SELECT * FROM (SELECT anchor, id, record, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 4
""")
def source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns behind each conversation's node, by what they share with its first turn."""
    t = table(spark, sf_dir, "conversations")
    anchors = t.groupBy(F.col("conv_id").alias("anchor")).agg(F.min_by("text", "turn").alias("question")).select("anchor", F.lit(4).alias("budget"), "question", F.lit(None).cast("timestamp").alias("starts"))
    records = t.select(F.col("conv_id").alias("node"), F.concat_ws("-", "conv_id", "turn").alias("record"), F.col("text").alias("content"), F.col("role").alias("speaker"), "turn", F.lit(None).cast("timestamp").alias("starts"))
    return N.evidence_of(anchors, records).select("anchor", "id", "record", "score", "rank")


@query(f"""
WITH {_NODES}, a AS (SELECT DISTINCT scope FROM n WHERE space % 2 = 0),
c AS (SELECT id, space, scope, kind, row_number() OVER (PARTITION BY scope ORDER BY space, starts, id) AS place FROM n WHERE kind IN ('event', 'semantic_state') AND scope IN (SELECT scope FROM a))
SELECT scope, kind, count(*) AS nodes, CAST(sum(place * (id % 101)) AS BIGINT) AS order_sum FROM c GROUP BY 1, 2
""")
def list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and states of scopes in their order (chain, start, id), told by a sum over places."""
    nodes = _nodes(spark, sf_dir).withColumn("chain", F.col("space")).withColumn("valid_from", F.col("starts"))
    own = N.listed(nodes, nodes.where("space % 2 = 0").select("scope"), ["event", "semantic_state"])
    return own.groupBy("scope", "kind").agg(F.count("*").alias("nodes"), F.sum(F.col("place") * (F.col("id") % 101)).alias("order_sum"))


@query("""
WITH r AS (SELECT o_custkey AS probe, list(o_orderkey % 700 ORDER BY o_orderkey DESC) AS ids FROM orders GROUP BY 1), u AS (SELECT probe, unnest(list_filter(ids, lambda x, i: list_position(ids, x) = i)) AS id, ids FROM r),
p AS (SELECT probe, id, list_position(list_filter(ids, lambda x, i: list_position(ids, x) = i), id) - 1 AS place FROM u) SELECT probe, CAST(place AS INTEGER) AS place, event_id AS id, event_type AS type FROM p JOIN events ON id = event_id
""")
def get_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in the order in which each customer's list names them; some are named twice, some are unknown."""
    o = table(spark, sf_dir, "orders")
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey"), asc=False), lambda k: k % 700)
    requests = o.groupBy(F.col("o_custkey").alias("probe")).agg(ids.alias("ids"))
    return N.fetched(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type")), requests).select("probe", "place", "id", "type")


@query("""
WITH f AS (SELECT user_id AS scope, event_type AS state, event_id AS id, ts AS valid_from FROM events), w AS (SELECT DISTINCT user_id AS scope, CASE WHEN user_id % 3 > 0 THEN event_type END AS state FROM events WHERE value >= 50)
SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY valid_from, id) AS place FROM f WHERE EXISTS (SELECT 1 FROM w WHERE w.scope = f.scope AND (w.state IS NULL OR w.state = f.state))
""")
def list_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the states asked for, or of a whole scope, in order."""
    e = table(spark, sf_dir, "events")
    facts = e.select(F.col("user_id").alias("scope"), F.col("event_type").alias("state"), F.col("event_id").alias("id"), F.col("ts").alias("valid_from"))
    asked = e.where("value >= 50").select(F.col("user_id").alias("scope"), F.when(F.col("user_id") % 3 > 0, F.col("event_type")).alias("state")).distinct()
    return N.facts_of(facts, asked).select("scope", "id", "place")


@query("""
WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS source, 'part' AS source_scope, l_suppkey AS target, 'supplier' AS target_scope, CASE l_returnflag WHEN 'R' THEN 'SAME_EVENT' WHEN 'A' THEN 'CAUSES' ELSE 'PART_OF' END AS type FROM lineitem),
a AS (SELECT p_partkey AS anchor, 'part' AS scope FROM part WHERE p_size <= 25 UNION SELECT s_suppkey, 'supplier' FROM supplier WHERE s_acctbal > 0),
o AS (SELECT anchor, id AS edge, type, target AS neighbour, target_scope AS neighbour_scope FROM e JOIN a ON anchor = source AND scope = source_scope WHERE type IN ('SAME_EVENT', 'CAUSES')),
b AS (SELECT anchor, id AS edge, type, source AS neighbour, source_scope AS neighbour_scope FROM e JOIN a ON anchor = target AND scope = target_scope WHERE type IN ('SAME_EVENT', 'CAUSES') AND id NOT IN (SELECT edge FROM o))
SELECT * FROM o UNION ALL SELECT * FROM b
""")
def cross_scope_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours over edges between scopes: parts and suppliers that lines connect, of two types, from either end."""
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "same_event").when(F.col("l_returnflag") == "A", "causes").otherwise("part_of")
    edges = line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source"), F.lit("part").alias("source_scope"), F.col("l_suppkey").alias("target"), F.lit("supplier").alias("target_scope"), F.upper(kind).alias("type"))
    anchors = table(spark, sf_dir, "part").where("p_size <= 25").select(F.lit("part").alias("scope"), F.col("p_partkey").alias("anchor")).union(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("supplier").alias("scope"), F.col("s_suppkey").alias("anchor")))
    return N.cross_adjacent(edges, anchors, ["same_event", "causes"]).select("anchor", "edge", "type", "neighbour", "neighbour_scope")


@query(f"""
WITH {_EDGES}, ed AS (SELECT source, target, type, struct_extract_at(b, 3) AS trust, struct_extract_at(b, 2) AS confidence FROM best),
hop AS (SELECT source AS anchor, target AS node, type, trust, confidence FROM ed WHERE trust <> 'derived' OR confidence >= 0.5 UNION ALL SELECT target, source, type, trust, confidence FROM ed WHERE trust <> 'derived' OR confidence >= 0.5),
s AS (SELECT e.user_id AS probe, anchor, node, type, round(0.75 * (node % 11) / 11.0 + 0.15 * CASE trust WHEN 'explicit' THEN 1.0 WHEN 'inferred' THEN 0.78 ELSE 0.42 END * confidence + 0.10 * (node % 10) / 10.0, 6) AS score FROM hop JOIN events e ON e.event_id = anchor JOIN events x ON x.event_id = node AND x.user_id = e.user_id),
m AS (SELECT probe, anchor, node, max((score, type)) AS b FROM s GROUP BY 1, 2, 3),
o AS (SELECT probe, anchor, node, struct_extract_at(b, 1) AS score, struct_extract_at(b, 2) AS type FROM m)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe, anchor ORDER BY score DESC, node) AS rank FROM o) WHERE rank <= 2
""")
def expand_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's two best neighbours towards an intent."""
    ev = table(spark, sf_dir, "events")
    anchors = ev.select(F.col("user_id").alias("probe"), F.col("event_id").alias("anchor"))
    like = ev.select(F.col("user_id").alias("probe"), F.col("event_id").alias("node"), ((F.col("event_id") % 11) / 11.0).alias("like"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    return G.expand_by_intent(anchors, G.oriented(_edges(spark, sf_dir)), like, 2)


@query("""
WITH n AS (SELECT user_id AS chain, event_id AS id, CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) THEN 'chain_head' WHEN event_id % 2 = 0 THEN 'event' ELSE 'semantic_state' END AS kind, ts AS t FROM events),
w AS (SELECT *, lead(id) OVER o AS next, lag(id) OVER o AS before FROM n WINDOW o AS (PARTITION BY chain, kind ORDER BY t, id)), h AS (SELECT chain, id AS head FROM n WHERE kind = 'chain_head'), dirty AS (SELECT DISTINCT user_id AS chain FROM events WHERE value > 95),
made AS (SELECT chain, id AS source, next AS target, 'TEMPORAL_NEXT' AS type FROM w WHERE kind = 'event' AND next IS NOT NULL UNION ALL SELECT chain, id, next, 'SEMANTIC_NEXT' FROM w WHERE kind = 'semantic_state' AND next IS NOT NULL UNION ALL SELECT chain, next, id, 'SUPERSEDES' FROM w WHERE kind = 'semantic_state' AND next IS NOT NULL
  UNION ALL SELECT chain, head, id, 'INITIAL_STATE' FROM w JOIN h USING (chain) WHERE kind = 'semantic_state' AND before IS NULL UNION ALL SELECT chain, head, id, 'CURRENT_STATE' FROM w JOIN h USING (chain) WHERE kind = 'semantic_state' AND next IS NULL)
SELECT chain, source, target, type FROM made WHERE chain IN (SELECT chain FROM dirty) UNION ALL SELECT DISTINCT user_id, -1, -2, 'OLD' FROM events WHERE user_id NOT IN (SELECT chain FROM dirty)
""")
def rebuilt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural edges of the chains that changed are made anew; each chain had one old edge."""
    e = table(spark, sf_dir, "events")
    last = F.max("event_id").over(Window.partitionBy("user_id"))
    kind = F.when(F.col("event_id") == last, "chain_head").when(F.col("event_id") % 2 == 0, "event").otherwise("semantic_state")
    nodes = e.select(F.col("user_id").alias("chain"), F.col("event_id").alias("id"), kind.alias("kind"), F.col("ts").alias("at"))
    old = e.select(F.col("user_id").alias("chain"), F.lit(-1).cast("long").alias("source"), F.lit(-2).cast("long").alias("target"), F.lit("OLD").alias("type")).distinct()
    return G.rebuilt(old, nodes, e.where("value > 95").select(F.col("user_id").alias("chain")))


@query("""
WITH r AS (SELECT l_orderkey AS w, l_linenumber AS a, l_linenumber % 3 + 1 AS b, CASE WHEN l_discount > 0.05 THEN 'CAUSES' ELSE 'PART_OF' END AS type, l_tax AS c FROM lineitem), n AS (SELECT l_orderkey AS w, l_linenumber AS ref, l_partkey AS id FROM lineitem)
SELECT x.id AS source, y.id AS target, type, max(c) AS confidence, 'derived' AS trust, CAST(0.7 AS DOUBLE) AS judged FROM r JOIN n x ON x.w = r.w AND x.ref = a JOIN n y ON y.w = r.w AND y.ref = b WHERE x.id <> y.id GROUP BY 1, 2, 3
""")
def stated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between local references become edges, and what a missing judge would leave them."""
    line = table(spark, sf_dir, "lineitem")
    relations = line.select(F.col("l_orderkey").alias("window"), F.col("l_linenumber").alias("from_ref"), (F.col("l_linenumber") % 3 + 1).alias("to_ref"), F.when(F.col("l_discount") > 0.05, "causes").otherwise("part_of").alias("type"), F.col("l_tax").alias("confidence"))
    edges = G.explicit_edges(relations, line.select(F.col("l_orderkey").alias("window"), F.col("l_linenumber").alias("ref"), F.col("l_partkey").alias("id")))
    judged = G.adjudicated(edges.withColumnRenamed("confidence", "stated"))
    return judged.select("source", "target", "type", F.col("stated").alias("confidence"), "trust", F.col("confidence").alias("judged"))


@query("""
WITH r AS (SELECT o_custkey AS probe, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority LIKE '%URGENT%' AS protected FROM orders),
m AS (SELECT probe, id, row_number() OVER (PARTITION BY probe ORDER BY rank) AS k FROM r WHERE rank > 6 AND protected), f AS (SELECT probe, rank, row_number() OVER (PARTITION BY probe ORDER BY rank DESC) AS k FROM r WHERE rank <= 6 AND NOT protected)
SELECT r.probe, coalesce(m.id, r.id) AS id, r.rank, m.id IS NOT NULL AS rescued FROM r LEFT JOIN f ON f.probe = r.probe AND f.rank = r.rank LEFT JOIN m ON m.probe = f.probe AND m.k = f.k WHERE r.rank <= 6
""")
def rescued_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's six best orders, urgent ones from below in place of others."""
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return SEL.rescued(o.select(F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("id"), rank.alias("rank"), F.col("o_orderpriority").contains("URGENT").alias("protected")), 6)


@query()
def controller_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner is shown of each customer's orders: their statuses are targets."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e6).cast("double").alias("score"), F.array("o_orderstatus", F.left("o_orderpriority", F.lit(1))).alias("targets"), (F.col("o_orderkey") % 5 == 0).alias("cited"), (F.col("o_orderkey") % 9 == 0).alias("protected"))
    needs = o.select(F.col("o_custkey").alias("probe")).distinct().withColumn("targets", F.array(*map(F.lit, ("F", "1", "3"))))
    return SEL.controller_evidence(rows, needs, limit=8, previous=2)


@query("""
WITH c AS (SELECT o_custkey AS probe, o_orderkey AS id, o_totalprice AS score, (o_orderkey % 3) * 0.02 AS reinforcement FROM orders), x AS (SELECT o_custkey AS probe, o_orderkey * 10 + l_linenumber % 2 AS expansion, o_orderkey AS anchor, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
cited AS (SELECT DISTINCT o_custkey AS probe, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45), p AS (SELECT x.probe, anchor AS id, count(DISTINCT expansion) AS paid FROM x JOIN cited USING (probe, id) GROUP BY 1, 2)
SELECT probe, id, round(CASE WHEN paid > 0 THEN least(0.06, reinforcement + 0.03 * paid) ELSE reinforcement END, 6) AS reinforcement FROM c LEFT JOIN p USING (probe, id)
""".replace("round(CASE", "round(CAST(CASE").replace("END, 6) AS reinforcement", "END AS DOUBLE), 6) AS reinforcement"))
def reinforced_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines led to parts that the customer cites gain, up to a limit."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    found = o.join(line, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("probe"), (F.col("o_orderkey") * 10 + F.col("l_linenumber") % 2).alias("expansion"), F.col("o_orderkey").alias("anchor"), F.col("l_partkey").alias("id"), "l_quantity")
    rows = o.select(F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), ((F.col("o_orderkey") % 3) * 0.02).alias("reinforcement"))
    return SEL.reinforced(rows, found, found.where("l_quantity > 45")).select("probe", "id", F.round("reinforcement", 6).alias("reinforcement"))


@query("""
WITH cited AS (SELECT o_custkey AS probe, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.08), given AS (SELECT DISTINCT o_custkey AS probe, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_tax < 0.06)
SELECT probe, count(*) AS missing FROM cited ANTI JOIN given USING (probe, id) GROUP BY 1
""")
def undelivered_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who cite parts that were not delivered to them."""
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("probe"), F.col("l_partkey").alias("id"), "l_discount", "l_tax")
    return R.undelivered(own.where("l_discount > 0.08").select("probe", "id"), own.where("l_tax < 0.06"))


@query()
def fallback_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's first open move when its first edges have been tried: its own results go before others, the evidence itself before links."""
    moves = I.catalog(*_found(spark, sf_dir)).withColumn("local", F.col("source").endswith("7")).withColumn("wants_source", F.col("probe") % 2 == 0)
    return I.first_open(moves, moves.where("action_id IN ('a1', 'a2')"))
