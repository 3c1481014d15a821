"""Queries on what questions ask for: documents stand for questions, events for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import intents as I
from mnemospark.operators import slots as S

from .registry import query, table

_LOW = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_KINDS = ", ".join(f"CASE WHEN {I.pattern_sql(p, 't')} THEN '{k}' END" for k, p in I.PATTERNS.items())
_FACETS = " || ".join(f"CASE WHEN list_contains(k, '{k}') THEN {list(v)} ELSE [] END" for k, v in I.FACETS.items())
_HAS = lambda *names: " OR ".join(f"list_contains(k, '{n}')" for n in names)
_SQL = f"""
t AS (SELECT doc_id, {_LOW} AS t FROM documents),
o AS (SELECT doc_id, t, list_filter([{_KINDS}], lambda x: x IS NOT NULL) AS own FROM t),
q AS (SELECT doc_id, t, CASE WHEN len(own) >= 2 OR {I.pattern_sql(I.COMPLEX, 't')} THEN own || ['complex'] ELSE own END AS k FROM o)
"""
_EDGES = f"""CASE WHEN len(k) = 0 OR {_HAS('why_how', 'hypothetical_reasoning', 'comparison')} THEN {list(I.CAUSAL)} ELSE [] END || CASE WHEN {_HAS('before_after')} THEN {list(I.TEMPORAL)} ELSE [] END
  || CASE WHEN {_HAS('current_latest')} THEN {list(I.CURRENT)} ELSE [] END || CASE WHEN {_HAS('current_latest', 'before_after')} THEN {list(I.HISTORY)} ELSE [] END || {[*I.SUPPORT, *I.CAUSAL, *I.TEMPORAL, *I.CURRENT, *I.HISTORY, *I.OTHERS]}"""


def _once(items: str) -> str:
    """A list with each of its values once, at its first place."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


@query(f"""
WITH {_SQL}, f AS (SELECT *, {_FACETS} AS f, {_EDGES} AS e, (len(k) = 0 OR {_HAS(*I.HARD)}) AS hard FROM q)
SELECT doc_id, array_to_string(k, ',') AS kinds, CASE WHEN len(f) = 0 THEN 'state,cause' ELSE array_to_string({_once('f')}, ',') END AS facets, CASE WHEN hard THEN 'complex' ELSE 'simple' END AS complexity,
  CASE WHEN hard THEN 12 ELSE 8 END AS probe_budget, array_to_string({_once('e')}, ',') AS edges, {_HAS('count_list')} AS by_entity, {_HAS('simultaneous')} AS by_overlap FROM f
""")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, facets, complexity, budget and edge order of every document read as a question."""
    df = I.analysed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return df.select("doc_id", joined("kinds"), joined("facets"), "complexity", "probe_budget", joined("edges"), "by_entity", "by_overlap")


_RESULTS = """
r AS (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, 'r' || event_id AS source, CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'semantic_state' ELSE 'chain_head' END AS node_type, event_id % 2 = 0 AS ended, event_id % 5 > 0 AS has_evidence, event_type, value FROM events)
"""


@query(f"""
WITH {_SQL}, {_RESULTS}, b AS (SELECT r.*, t, k, {_once(_EDGES)} AS edges FROM r JOIN (SELECT * FROM q) q USING (doc_id)),
d AS (SELECT *, {I.pattern_sql(I.BEFORE, 't')} AS before, {I.pattern_sql(I.AFTER, 't')} AS after FROM b),
e AS (SELECT doc_id, source, 'TEMPORAL_NEXT' AS action, 'in' AS direction, k, edges, before, after FROM d UNION ALL SELECT doc_id, source, 'TEMPORAL_NEXT', 'out', k, edges, before, after FROM d
  UNION ALL SELECT doc_id, source, CASE WHEN value >= 50 THEN 'CAUSES' ELSE 'KNOWS' END, 'out', k, edges, before, after FROM d),
m AS (SELECT doc_id, source, action, direction, coalesce(list_position(edges, action) - 1, 999) AS p, CASE WHEN action = 'TEMPORAL_NEXT' AND list_contains(k, 'before_after') AND direction <> CASE WHEN before AND NOT after THEN 'in' ELSE 'out' END THEN 1 ELSE 0 END AS turn FROM e
  UNION ALL SELECT doc_id, source, 'SOURCE_EVIDENCE_LOOKUP', 'lookup', 880, 0 FROM d WHERE has_evidence
  UNION ALL SELECT doc_id, source, 'TEMPORAL_BEFORE_LOOKUP', 'lookup', 890, 0 FROM d WHERE node_type = 'event' AND list_contains(k, 'before_after') AND before
  UNION ALL SELECT doc_id, source, 'TEMPORAL_AFTER_LOOKUP', 'lookup', 891, 0 FROM d WHERE node_type = 'event' AND list_contains(k, 'before_after') AND after
  UNION ALL SELECT doc_id, source, 'NEAREST_TIME_LOOKUP', 'lookup', 892, 0 FROM d WHERE node_type = 'event' AND list_contains(k, 'nearest_time')
  UNION ALL SELECT doc_id, source, 'CROSS_ENTITY_LOOKUP', 'lookup', 899, 0 FROM d WHERE node_type <> 'chain_head' AND list_contains(k, 'cross_entity')
  UNION ALL SELECT doc_id, source, 'ENTITY_LOOKUP', 'lookup', 900, 0 FROM d WHERE node_type <> 'chain_head' AND list_contains(k, 'count_list')
  UNION ALL SELECT doc_id, source, 'TIME_OVERLAP_LOOKUP', 'lookup', 901, 0 FROM d WHERE node_type = 'event' AND ended AND list_contains(k, 'simultaneous'))
SELECT doc_id AS probe, 'a' || row_number() OVER (PARTITION BY doc_id ORDER BY p, turn, source, action, direction) AS action_id, source, action, direction FROM m
""")
def action_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves that are open to each question, from the edges and lookups of the events that it found."""
    return I.catalog(*_found(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    id_ = F.col("event_id")
    kind = F.when(id_ % 3 == 0, "event").when(id_ % 3 == 1, "semantic_state").otherwise("chain_head")
    option = lambda edge, way: F.struct(F.lit(edge).alias("edge_type") if isinstance(edge, str) else edge.alias("edge_type"), F.lit(way).alias("direction"))
    options = F.array(option("temporal_next", "in"), option("TEMPORAL_NEXT", "OUT"), option("TEMPORAL_NEXT", "out"), option(F.when(F.col("value") >= 50, "CAUSES").otherwise("KNOWS"), "out"), option("CAUSES", "sideways"))
    found = table(spark, sf_dir, "events").select((id_ % n).alias("probe"), F.concat(F.lit("r"), id_.cast("string")).alias("source"), kind.alias("node_type"), F.col("ts").alias("starts"), F.when(id_ % 2 == 0, F.col("ts")).alias("ends"), (id_ % 5 > 0).alias("has_evidence"), options.alias("options"))
    return docs.select(F.col("doc_id").alias("probe"), "text"), found


@query(r"""
SELECT item_id, CASE item_id % 3 WHEN 0 THEN '{"id": ' || item_id || ', "note": "a } in a string"}' WHEN 1 THEN '{"inner": {"id": ' || item_id || '}}' END AS found FROM benchmark
""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects out of prose and fences: braces that are no JSON are passed over, and some texts have none."""
    id_ = F.col("item_id").cast("string")
    said = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('{oops} Sure:\n```json\n{"id": '), id_, F.lit(', "note": "a } in a string"}\n``` {"id": 0}'))).when(F.col("item_id") % 3 == 1, F.concat(F.lit('{not: this} {"inner": {"id": '), id_, F.lit("}} done"))).otherwise(F.concat(F.lit("{ none "), id_))
    return table(spark, sf_dir, "benchmark").select("item_id", S.json_object_column(said).alias("found"))
