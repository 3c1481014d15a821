"""Retrieval over the timeline graph: lookups in time, relations' scores, rounds; and filters on nested and JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions.shared import stored
from mnemospark.operators import graph as G
from mnemospark.operators import planner as P
from mnemospark.operators import runtime as R
from mnemospark.operators import temporal as T
from mnemospark.operators.search import ranked

from .construction import _edges
from .registry import query, table


@query()
def retrieval_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a probe; its first search are the five events of highest value, relevance the value itself."""
    ev = table(spark, sf_dir, "events")
    found = ranked(ev.select(F.col("user_id").alias("probe"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score")), ["probe"], [F.desc("score"), F.col("id")], 5)
    rel = ev.select(F.col("user_id").alias("probe"), F.col("event_id").alias("node"), F.round(F.col("value") / 100, 6).alias("rel"))
    return R.retrieve(found, G.oriented(_edges(spark, sf_dir)), rel)


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every user is a question in three parts. Its events are nodes: they tell their type, and have it, their hour and the
    last digit of k as terms. An event leads to the user's next one, to the next one of its k by whoever it is, and, as its source, to the one before."""
    ev = stored(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k")))
    kind, score = F.col("event_type"), F.round(F.col("value") / 100, 6)
    terms = F.array(kind, F.concat(F.lit("k"), F.col("k") % 10), F.concat(F.lit("h"), F.hour("ts")))
    nodes = ev.select(F.col("user_id").alias("question"), F.col("event_id").alias("id"), F.explode(terms).alias("term"))
    facets = ev.select(F.col("event_id").alias("id"), kind.alias("facet")).unionByName(ev.select(F.col("event_id").alias("id"), F.concat(F.lit("k"), F.col("k") % 10).alias("facet")))
    own, same = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("k").orderBy("ts", "event_id")
    step = lambda name, way, n, move, w: ev.select(F.col("event_id").alias("source"), F.lit(name).alias("action"), F.lit(way).alias("direction"), F.lit(n).alias("priority"), move("event_id").over(w).alias("id"), move(score).over(w).alias("score")).where("id IS NOT NULL")
    moves = step("TEMPORAL_NEXT", "forward", 1, F.lead, own).unionByName(step("SAME_K", "forward", 2, F.lead, same)).unionByName(step("SOURCE_EVIDENCE_LOOKUP", "backward", 3, F.lag, own))
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    digit = F.concat(F.lit("k"), F.col("user_id") % 10)
    part = lambda name, needs, must, should, entities=words(): F.struct(F.lit(name).alias("target"), needs.alias("facets"), F.lit(name).alias("query"), must.alias("must"), should.alias("should"), entities.alias("entities"))
    parts = F.array(
        part("root", F.array(F.lit("purchase"), digit), words("purchase"), F.array(digit)),
        part("hour", words("signup", "error"), words("signup", "h3"), words("error")),
        part("view", words("k5"), words("view"), words(), words("h25")),
    )
    users = ev.select("user_id").distinct().select(F.col("user_id").alias("question"), F.lit(True).alias("required"), F.inline(F.transform(parts, lambda p: p)))
    return P.run(users, P.by_terms(nodes), moves, facets)


@query()
def planner_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question has found when its rounds end, cited evidence first, and why and when they ended."""
    evidence, outcome, _ = _planned(spark, sf_dir)
    return evidence.join(outcome, "question")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / 1000000 AS s, lang AS target, [lang || n_chars % 2, source, 'n' || (n_chars % 7)] AS t FROM documents), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY s DESC, doc_id) <= 16),
gap AS (SELECT a.target, a.doc_id AS a, b.doc_id AS b, 1 - len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) AS g FROM f a JOIN f b USING (target)),
pick AS (SELECT target, 1 AS place, arg_min(doc_id, (-s, doc_id)) AS doc_id, [arg_min(doc_id, (-s, doc_id))] AS chosen FROM f GROUP BY target UNION ALL
  SELECT target, place, doc_id, list_append(chosen, doc_id) FROM (SELECT p.target, p.place + 1 AS place, p.chosen, f.doc_id, row_number() OVER (PARTITION BY p.target ORDER BY (SELECT min(g) FROM gap WHERE b = f.doc_id AND list_contains(p.chosen, a)) DESC, f.s DESC, f.doc_id) AS k
    FROM pick p JOIN f ON f.target = p.target AND NOT list_contains(p.chosen, f.doc_id) WHERE p.place < 4) WHERE k = 1)
SELECT 0 AS question, target, doc_id AS probe, CAST(place AS BIGINT) AS place FROM pick
""")
def diverse_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four documents of each language that differ most in their terms, of the sixteen longest, as probes."""
    n = F.col("n_chars")
    terms = F.array(F.concat("lang", n % 2), F.col("source"), F.concat(F.lit("n"), n % 7))
    rows = table(spark, sf_dir, "documents").select(F.lit(0).alias("question"), F.col("lang").alias("target"), F.col("doc_id").alias("probe"), terms.alias("terms"), (n / 1_000_000).alias("score"))
    return P.spread(rows, 4, most=16)


@query("""
WITH n AS (SELECT event_id, user_id, value, CASE CAST(json_extract(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'absolute' WHEN 1 THEN 'resolved_relative' WHEN 2 THEN 'unresolved' END AS status FROM events)
SELECT user_id, count(*) AS nodes, count_if(coalesce(status, 'absolute') IN ('absolute', 'resolved_relative')) AS reliable FROM n GROUP BY 1
""")
def reliable_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a user's nodes may answer hard questions about time: status from JSON, none means absolute."""
    k = F.get_json_object("props", "$.k").cast("long") % 4
    status = F.when(k == 0, "absolute").when(k == 1, "resolved_relative").when(k == 2, "unresolved")
    meta = F.to_json(F.struct(status.alias("normalization_status")))
    ok = F.coalesce(F.get_json_object(meta, "$.normalization_status"), F.lit("absolute")).isin("absolute", "resolved_relative")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("nodes"), F.count_if(ok).alias("reliable"))


@query("""
WITH f AS (SELECT user_id, event_type, ts AS vf, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS vt FROM events), b AS (SELECT user_id, min(ts) + INTERVAL 3 DAY AS s, min(ts) + INTERVAL 4 DAY AS e FROM events GROUP BY 1)
SELECT user_id, count(*) AS facts, count_if(vf <= e AND coalesce(vt, TIMESTAMP '9999-12-31') >= s) AS between_days, count_if(vt IS NOT NULL AND vt < s) AS before_days, count_if(vf > e) AS after_days FROM f JOIN b USING (user_id) GROUP BY 1
""")
def hard_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each user that hold between, before and after two moments; an open end lasts for ever."""
    facts = T.validity(table(spark, sf_dir, "events").withColumn("id", F.col("event_id")), ["user_id", "event_type"])
    w = Window.partitionBy("user_id")
    first = F.min("ts").over(w)
    at = facts.select("user_id", "valid_from", "valid_to", (first + F.expr("INTERVAL 3 DAYS")).alias("s"), (first + F.expr("INTERVAL 4 DAYS")).alias("e"))
    inside = (F.col("valid_from") <= F.col("e")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("s")))
    return at.groupBy("user_id").agg(F.count("*").alias("facts"), F.count_if(inside).alias("between_days"), F.count_if(F.coalesce(F.col("valid_to") < F.col("s"), F.lit(False))).alias("before_days"), F.count_if(F.col("valid_from") > F.col("e")).alias("after_days"))


@query("""
WITH c AS (SELECT o_orderkey AS id, o_custkey AS probe, o_totalprice AS x FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY x DESC, id) AS n, id % 4 = 0 AS head FROM c),
q AS (SELECT *, row_number() OVER (PARTITION BY probe, head ORDER BY x DESC, id) AS m FROM r)
SELECT probe, id, head, row_number() OVER (PARTITION BY probe ORDER BY x DESC, id) AS rank FROM q WHERE (head AND m <= 3) OR (NOT head AND m <= 5)
""")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five pieces of evidence and three chain heads of each probe, in order of score."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 4 == 0).alias("head"))
    few = ranked(c, ["probe", "head"], [F.desc("x"), F.col("id")], F.when(F.col("head"), 3).otherwise(5), "m")
    return few.select("probe", "id", "head", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("x"), "id")).cast("long").alias("rank"))


@query("""
WITH old AS (SELECT event_id, md5(CAST(round(value, 3) AS VARCHAR) || event_type) AS h, value FROM events WHERE event_id % 3 <> 0), new AS (SELECT event_id, md5(CAST(round(value, 3) AS VARCHAR) || event_type) AS h, value + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS value FROM events WHERE event_id % 3 <> 1)
SELECT CASE WHEN o.event_id IS NULL THEN 'added' WHEN n.event_id IS NULL THEN 'removed' WHEN o.value <> n.value THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM old o FULL JOIN new n USING (event_id) GROUP BY 1
""")
def dirty_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two generations of a table."""
    ev = table(spark, sf_dir, "events")
    old = ev.where("event_id % 3 <> 0").select("event_id", F.col("value").alias("before"), F.lit(True).alias("had"))
    new = ev.where("event_id % 3 <> 1").select("event_id", (F.col("value") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)).alias("after"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return old.join(new, "event_id", "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT l_orderkey AS node, list_sort(list_distinct(list(l_partkey))) AS e FROM lineitem GROUP BY 1), p AS (SELECT p1.node AS a, p2.node AS b, len(list_intersect(p1.e, p2.e)) AS c, len(list_distinct(p1.e || p2.e)) AS u FROM b p1 JOIN b p2 ON p1.node < p2.node AND list_has_any(p1.e, p2.e))
SELECT c AS shared, count(*) AS pairs, round(max(c / u), 6) AS best FROM p GROUP BY 1
""")
def entity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of orders by their parts: pairs meet on common parts, each with its own few, and are counted at the smallest of those in common, so no pair is shuffled."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_set("l_partkey").alias("s"))
    a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"), F.explode("s").alias("e")) for x in "ab")
    met = a.join(b, "e").where("a < b").select("e", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.array_intersect("s_a", "s_b").alias("i")).where(F.array_min("i") == F.col("e"))
    c = F.size("i").cast("long")
    return met.groupBy(c.alias("shared")).agg(F.count("*").alias("pairs"), F.round(F.max(c / (F.col("n_a") + F.col("n_b") - c)), 6).alias("best"))


@query("""
WITH t AS (SELECT doc_id, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '[A-Z][A-Za-z]{2,}')]) AS e FROM documents) SELECT doc_id, len(e) AS names, coalesce(array_to_string(list_sort(e)[1:5], ','), '') AS first_names FROM t
""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct capitalised names of each text, whatever their case."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Z][A-Za-z]{2,})"), F.lit(1)), F.lower))
    return table(spark, sf_dir, "documents").select("doc_id", names.alias("e")).select("doc_id", F.size("e").cast("long").alias("names"), F.array_join(F.slice(F.sort_array("e"), 1, 5), ",").alias("first_names"))
