"""Queries on whom and what is meant: vectors are mentions, labels' centres entities and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.shared import stored
from mnemospark.operators import entities as EN
from mnemospark.operators import registry as REG
from mnemospark.operators import search as S

from .registry import query, table
from .search import _CENTRES, _COSINE, _centres, _vectors

_MENTIONS = f"""
{_CENTRES}, m AS (SELECT vec_id, embedding, CASE WHEN vec_id % 9 = 0 THEN '  C' || label || ' ' ELSE 'v' || vec_id END AS alias, 't' || (label % 3) AS type FROM embeddings),
one AS (SELECT alias, type, min(vec_id) AS vec_id FROM m GROUP BY 1, 2), u AS (SELECT m.* FROM m JOIN one USING (alias, type, vec_id)), r AS (SELECT probe AS id, pv, 't' || (probe % 3) AS type FROM centre),
n AS (SELECT alias, u.type, r.id, round({_COSINE}, 6) AS likeness FROM u JOIN r USING (type)), best AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY alias, type ORDER BY likeness DESC, id) AS k FROM n) WHERE k = 1)
"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    alias = F.when(F.col("id") % 9 == 0, F.concat(F.lit("  C"), F.col("label"), F.lit(" "))).otherwise(F.concat(F.lit("v"), F.col("id")))
    at = v.select("id", "v", alias.alias("alias"), F.concat(F.lit("t"), F.col("label") % 3).alias("type"))
    return at.groupBy("alias", "type").agg(F.min_by("v", "id").alias("v"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(_centres(spark, sf_dir).select(F.col("probe").alias("id"), F.concat(F.lit("t"), F.col("probe") % 3).alias("type"), F.col("probe").alias("place"), F.array(F.concat(F.lit("c"), F.col("probe")), F.concat(F.lit("the "), F.col("probe"))).alias("aliases"), F.col("pv").alias("v")))


@query(f"WITH {_MENTIONS} SELECT alias, type, id, likeness FROM best")
def nearest_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of its type that each mention is most like, by cosine."""
    return EN.nearest_of_type(_mentions(spark, sf_dir), _registry(spark, sf_dir)).withColumnRenamed("like", "likeness")


@query(f"WITH {_MENTIONS} SELECT alias, u.type, r.id FROM u JOIN r ON r.type = u.type AND lower(trim(alias)) IN ('c' || r.id, 'the ' || r.id)")
def exact_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.exact(_mentions(spark, sf_dir), _registry(spark, sf_dir))


@query(f"""
WITH {_MENTIONS}, x AS (SELECT alias, type, CASE WHEN lower(trim(alias)) LIKE 'c%' THEN CAST(substr(trim(alias), 2) AS BIGINT) END AS named, id, likeness FROM best)
SELECT alias, type, CASE WHEN named IS NOT NULL THEN CAST(named AS VARCHAR) WHEN likeness >= 0.3 THEN CAST(id AS VARCHAR) ELSE 'entity_' || left(sha256('s␟' || type || '␟' || lower(trim(alias))), 24) END AS id, CASE WHEN named IS NOT NULL THEN 'exact' WHEN likeness >= 0.3 THEN 'alike' ELSE 'new' END AS how FROM x
""")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each mention means: by name, by likeness from 0.3 on (which nothing that is named reaches elsewhere), or someone new."""
    mentions = _mentions(spark, sf_dir)
    named = mentions.join(EN.exact(mentions, _registry(spark, sf_dir)), ["alias", "type"], "left_semi")
    out, _ = EN.canonical(mentions.join(named.select("alias", "type"), ["alias", "type"], "left_anti").unionByName(named.withColumn("v", F.transform("v", lambda x: x * 0))), _registry(spark, sf_dir), "s", high=0.3, low=0.3)
    return out


@query(f"""
WITH {_CENTRES}, c AS (SELECT probe AS place, 'topic ' || probe AS topic, pv FROM centre), e AS (SELECT vec_id AS id, embedding, CASE WHEN vec_id % 4 = 0 THEN 'Topic ' || label WHEN vec_id % 4 = 1 THEN 'also ' || label ELSE 'My Own, no. ' || vec_id END AS topic FROM embeddings),
n AS (SELECT id, place FROM e JOIN c ON lower(e.topic) IN (c.topic, 'also ' || place)), a AS (SELECT id, c.topic, round({_COSINE}, 6) AS s, place FROM e, (SELECT *, topic AS t FROM c WHERE place < 8) c WHERE id NOT IN (SELECT id FROM n)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, place) AS k FROM a) WHERE k = 1 AND s >= 0.25)
SELECT e.id, CASE WHEN n.place IS NOT NULL THEN 'topic ' || n.place WHEN b.topic IS NOT NULL THEN b.topic ELSE 'my_own_no_' || e.id END AS topic, CASE WHEN n.place IS NOT NULL THEN 'named' WHEN b.topic IS NOT NULL THEN 'alike' ELSE 'new' END AS how FROM e LEFT JOIN n USING (id) LEFT JOIN b USING (id)
""")
def routed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of each event: by name or alias, by likeness to the first eight, or a new one."""
    i = F.col("id")
    topic = F.when(i % 4 == 0, F.concat(F.lit("Topic "), F.col("label"))).when(i % 4 == 1, F.concat(F.lit("also "), F.col("label"))).otherwise(F.concat(F.lit("My Own, no. "), i))
    events = _vectors(spark, sf_dir).select(F.lit("s").alias("scope"), "id", topic.alias("topic"), F.lit(None).cast("array<string>").alias("aliases"), "v")
    chains = _centres(spark, sf_dir).select(F.lit("s").alias("scope"), F.col("probe").alias("place"), F.concat(F.lit("topic "), F.col("probe")).alias("topic"), F.array(F.concat(F.lit("also "), F.col("probe"))).alias("names"), F.col("pv").alias("v"))
    return EN.routed(events, chains, least=0.25).select("id", "topic", "how")


_EXTRACTED = """
e AS (SELECT l_orderkey AS w, 'e' || l_linenumber AS ref, CASE WHEN l_returnflag = 'N' AND l_tax > 0.06 THEN '' ELSE l_returnflag END AS title FROM lineitem),
r AS (SELECT l_orderkey AS w, l_partkey AS place, 'e' || l_linenumber AS source, 'e' || (l_linenumber % 4 + 1) AS target, CASE WHEN l_discount > 0.08 THEN 'KNOWS' ELSE 'causes' END AS type, CASE WHEN l_tax > 0.01 THEN CAST(l_quantity AS DOUBLE) / 45 END AS confidence FROM lineitem)
"""


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "window")
    ref = lambda c: F.concat(F.lit("e"), c)
    n = F.col("l_linenumber")
    events = line.select("window", ref(n).alias("ref"), F.when((F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.06), "").otherwise(F.col("l_returnflag")).alias("title"), F.lit(None).cast("string").alias("summary"))
    relations = line.select("window", F.col("l_partkey").alias("place"), ref(n).alias("source"), ref(n % 4 + 1).alias("target"), F.when(F.col("l_discount") > 0.08, "KNOWS").otherwise("causes").alias("type"), F.when(F.col("l_tax") > 0.01, F.col("l_quantity").cast("double") / 45).alias("confidence"))
    claims = line.select("window", F.lit("user").alias("subject"), F.lit("d").alias("dimension"), F.when(n < 7, "a").otherwise(" ").alias("aspect"), F.lit("x").alias("value"))
    return events, relations, claims


@query(f"""
WITH {_EXTRACTED}, g AS (SELECT *, coalesce(confidence, 1.0) AS c FROM r WHERE source <> target AND (w, source) IN (SELECT (w, ref) FROM e) AND (w, target) IN (SELECT (w, ref) FROM e))
SELECT w AS window_id, source, target, upper(arg_min(type, (-c, place, type))) AS type, max(c) AS confidence FROM g GROUP BY 1, 2, 3
""")
def normalised_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation for each directed pair of a window's events, the surest."""
    events, relations, _ = _extracted(spark, sf_dir)
    ordered = relations.withColumn("place", F.struct("place", "type"))
    return EN.normalised_relations(ordered, events).withColumnRenamed("window", "window_id")


@query(f"""
WITH {_EXTRACTED}, x AS (SELECT w, 'ref used twice' AS error FROM e GROUP BY w, ref HAVING count(*) > 1 UNION ALL SELECT w, 'event without title and summary' FROM e WHERE title = '' UNION ALL SELECT l_orderkey, 'incomplete claim' FROM lineitem WHERE l_linenumber >= 7 UNION ALL SELECT w, 'relation to itself' FROM r WHERE source = target
  UNION ALL SELECT w, 'unknown relation' FROM r WHERE type = 'KNOWS' UNION ALL SELECT w, 'confidence out of range' FROM r WHERE confidence > 1 UNION ALL SELECT w, 'unknown target' FROM r WHERE (w, target) NOT IN (SELECT (w, ref) FROM e))
SELECT w AS window_id, error, count(*) AS n FROM x GROUP BY 1, 2
""")
def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, relations, claims = _extracted(spark, sf_dir)
    return EN.extraction_errors(events, relations, claims).withColumnRenamed("window", "window_id")


@query("""
WITH v AS (SELECT DISTINCT l_orderkey AS scope, 'D' || l_linenumber || ':evidence-of-line-' || l_linenumber AS id, l_linenumber AS n FROM lineitem)
SELECT scope, CASE n % 4 WHEN 0 THEN id WHEN 1 THEN upper(replace(id, '-', ' ')) WHEN 2 THEN replace(id, 'evidence', 'evidense') ELSE 'nothing like it' END AS value, CASE WHEN n % 4 < 3 THEN id END AS id, ['exact', 'normalized', 'close', 'none'][1 + n % 4] AS how FROM v
""")
def repaired_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evidence is meant: as written, but for punctuation and case, or misspelt where only one comes near."""
    n = F.col("l_linenumber")
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scope"), F.concat(F.lit("D"), n, F.lit(":evidence-of-line-"), n).alias("id"), n.alias("n")).distinct()
    value = F.when(F.col("n") % 4 == 0, F.col("id")).when(F.col("n") % 4 == 1, F.upper(F.translate("id", "-", " "))).when(F.col("n") % 4 == 2, F.replace("id", F.lit("evidence"), F.lit("evidense"))).otherwise("nothing like it")
    out = EN.repaired_ids(v.select("scope", value.alias("value"), "n").select("scope", "value"), v)
    # values that mean nothing are one row a scope: each line that has one is shown
    return v.select("scope", value.alias("value")).join(out, ["scope", "value"])


@query(f"""
WITH {_CENTRES}, s AS (SELECT probe, vec_id AS id, embedding, round({_COSINE}, 6) AS score FROM embeddings, centre), top AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 32),
x AS (SELECT *, id % 4 AS source, id % 3 AS entity, CASE WHEN id % 5 > 0 THEN id % 50 END AS d FROM top),
p AS (SELECT a.probe, a.id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS c
  FROM x a JOIN x b ON a.probe = b.probe AND b.rank < a.rank AND (a.source = b.source OR (a.entity = b.entity AND a.d IS NOT NULL AND b.d IS NOT NULL)) AND NOT coalesce(a.d + 9 < b.d OR b.d + 9 < a.d, FALSE))
SELECT probe, id, score, round(coalesce((SELECT CASE WHEN max(c) IS NOT NULL THEN least(0.08, max(c) - 0.15) END FROM p WHERE p.probe = x.probe AND p.id = x.id AND c >= 0.15), 0.0), 6) AS penalty FROM x
""")
def near_duplicates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What likeness to a better candidate costs (here from 0.15 on) where sources, or entities at known times, are shared and times agree."""
    v = _vectors(spark, sf_dir)
    top = S.dense(_centres(spark, sf_dir), v, 32).drop("rank").join(v.select("id", "v"), "id")
    at = F.when(F.col("id") % 5 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")))
    c = top.select("probe", "id", "score", "v", F.array(F.col("id") % 4).alias("sources"), F.array(F.col("id") % 3).alias("entities"), at.alias("starts"), F.date_add(at, 9).alias("ends"))
    return EN.near_duplicate_penalties(c, like=0.15).withColumn("penalty", F.round("penalty", 6))


def _named_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a mention in one of four namespaces; one in nine has the name of a label, in three spellings."""
    i = F.col("id")
    alias = F.when(i % 9 == 0, F.concat(F.lit("  C"), F.col("label"), F.lit(" "))).when(i % 9 == 1, F.concat(F.lit("C"), F.col("label"))).otherwise(F.concat(F.lit("v"), i))
    kind = F.when(F.col("label") % 3 == 0, "gpe").when(F.col("label") % 3 == 1, "entity").otherwise("object")
    return _vectors(spark, sf_dir).select((F.concat(F.lit("n"), i % 4)).alias("namespace"), i.alias("place"), alias.alias("alias"), kind.alias("type"), "v")


def _known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second label is an entity that all namespaces know from the start."""
    p = F.col("probe")
    kind = F.when(p % 3 == 0, "gpe").when(p % 3 == 1, "entity").otherwise("object")
    spaces = F.explode(F.array(*(F.lit(f"n{n}") for n in range(4))))
    return stored(_centres(spark, sf_dir).where("probe % 2 = 0").select(spaces.alias("namespace"), F.concat(F.lit("e"), p).alias("id"), kind.alias("type"), p.alias("place"), F.array(F.concat(F.lit("c"), p)).alias("aliases"), F.col("pv").alias("v")))


@query()
def grown_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom every mention means where the registry grows in order of the mentions; likeness counts from 0.3 on, as nothing here is more alike."""
    out, _ = REG.grown(REG.collected(_named_mentions(spark, sf_dir)), _known_entities(spark, sf_dir), high=0.3, low=0.25, conservative=False)
    return out


@query()
def registry_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is asked before anything is taken for the same, new entities included."""
    _, asked = REG.grown(REG.collected(_named_mentions(spark, sf_dir)), _known_entities(spark, sf_dir), high=0.3, low=0.25)
    return asked


@query("""
WITH m AS (SELECT 'n' || (vec_id % 4) AS namespace, vec_id, trim(CASE WHEN vec_id % 9 = 0 THEN '  C' || label || ' ' WHEN vec_id % 9 = 1 THEN 'C' || label ELSE 'v' || vec_id END) AS alias, ['gpe', 'entity', 'object'][1 + label % 3] AS type, label FROM embeddings)
SELECT namespace, arg_min(alias, vec_id) AS alias, arg_min(type, vec_id) AS type, 'e' || any_value(label) AS id, 'exact' AS how FROM m WHERE lower(alias) = 'c' || label AND label % 2 = 0 GROUP BY namespace, lower(alias)
""")
def registry_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions whose name an entity has that was known from the start."""
    out, _ = REG.grown(REG.collected(_named_mentions(spark, sf_dir)), _known_entities(spark, sf_dir), high=2.0, low=2.0, conservative=False)
    return out.where("how = 'exact'")
