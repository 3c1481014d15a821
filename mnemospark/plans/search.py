"""Search queries: documents are nodes, benchmark texts are probes, labels' mean vectors are vector probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions.shared import stored
from mnemospark.operators import search as S
from mnemospark.operators import texts as X
from mnemospark.operators import vectors as V

from .registry import query, table

_POST = r"""
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_'']+') AS t FROM documents),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY id, term),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT id, max(dl) AS dl FROM post GROUP BY id)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
ptok AS (SELECT item_id AS probe, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS d, regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') AS t FROM benchmark),
pterm AS (SELECT probe, term, r FROM (SELECT probe, term, row_number() OVER (PARTITION BY probe ORDER BY first) AS r FROM (
  SELECT probe, term, min(i) AS first FROM (SELECT probe, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM ptok) GROUP BY probe, term)) WHERE r <= 16),
hit AS (SELECT probe, id, count(*) AS n_terms, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM pterm JOIN dfs USING (term) JOIN post USING (term), corpus GROUP BY probe, id)
"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("probe"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector a label: the mean of its vectors."""
    at = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"))
    means = at.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")).select(F.col("label").cast("long").alias("probe"), F.transform("p", lambda s: F.round(s["x"], 9)).alias("pv"))


_CENTRES = """
parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
means AS (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 9) AS x FROM parts GROUP BY label, i),
centre AS (SELECT CAST(label AS BIGINT) AS probe, list(x ORDER BY i) AS pv FROM means GROUP BY label)
"""
_COSINE = "greatest(0.0, list_dot_product(CAST(embedding AS DOUBLE[]), pv) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(pv, pv))))"


@query(f"""
WITH {_CENTRES},
s AS (SELECT probe, vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings, centre)
SELECT * FROM (SELECT probe, id, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10
""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dense(_centres(spark, sf_dir), _vectors(spark, sf_dir), 10)


@query(f"""
WITH {_CENTRES},
s AS (SELECT probe, vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings, centre)
SELECT * FROM (SELECT probe, id, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10
""")
def dense_topk_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `dense_topk`, from cells that angles prune exactly."""
    found, _ = V.topk(_centres(spark, sf_dir), V.celled(_vectors(spark, sf_dir)), 10)
    return found


def _counted(spark: SparkSession, sf_dir: str, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """Nodes with how often they have the probes' first terms, and those terms."""
    terms = S.probe_terms(_probes(spark, sf_dir), most)
    return stored(S.counted(_nodes(spark, sf_dir), terms)), terms


@query(f"WITH {_POST} SELECT * FROM (SELECT probe, id, n_terms, round(bm25, 6) AS score, row_number() OVER (PARTITION BY probe ORDER BY round(bm25, 6) DESC, id) AS rank FROM hit) WHERE rank <= 20")
def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, terms = _counted(spark, sf_dir)
    nodes = S.one_an_id(nodes)
    return S.bm25_best(nodes, S.weights_of(nodes, terms).withColumn("need", F.lit(1)), 20)


_BM25 = "sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))"


def _structured(k: int) -> str:
    """SQL of structured search: must are a probe's first four terms, should the next eight; each part its k best."""
    return f"""
need AS (SELECT probe, count(*) AS k FROM pterm WHERE r <= 4 GROUP BY probe),
sa AS (SELECT probe, id, round({_BM25}, 6) AS s, count(*) AS c FROM pterm JOIN dfs USING (term) JOIN post USING (term), corpus WHERE r <= 4 GROUP BY probe, id),
sb AS (SELECT probe, id, s FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY s DESC, id) AS n FROM sa JOIN need USING (probe) WHERE c = k) WHERE n <= {k}),
own AS (SELECT probe, id, s / max(s) OVER (PARTITION BY probe) AS strict FROM sb),
ba AS (SELECT probe, id, round({_BM25}, 6) AS s FROM pterm JOIN dfs USING (term) JOIN post USING (term), corpus WHERE r <= 12 GROUP BY probe, id),
bb AS (SELECT probe, id, s FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY s DESC, id) AS n FROM ba) WHERE n <= {k}),
broad AS (SELECT probe, id, s / max(s) OVER (PARTITION BY probe) AS broad FROM bb),
any_strict AS (SELECT DISTINCT probe, TRUE AS has FROM own),
structured AS (SELECT * FROM (SELECT probe, id, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM (
  SELECT probe, id, round(CASE WHEN has THEN 0.7 * coalesce(strict, 0) + 0.3 * coalesce(broad, 0) ELSE broad END, 6) AS score
  FROM broad FULL JOIN own USING (probe, id) LEFT JOIN any_strict USING (probe))) WHERE rank <= {k})"""


@query(f"WITH {_POST}, {_structured(20)} SELECT * FROM structured")
def bm25_strict_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the first four terms weigh 0.7 and any of the first twelve 0.3; any alone where nothing has all four."""
    nodes, terms = _counted(spark, sf_dir, 12)
    return S.structured(nodes, terms.where("place < 4"), terms.where("place >= 4"), 20)


@query(f"""
WITH {_POST.replace(" WHERE r <= 16", "")}, need AS (SELECT probe, count(*) AS k FROM pterm GROUP BY probe)
SELECT * FROM (SELECT probe, id, round(n_terms / k, 6) AS score, row_number() OVER (PARTITION BY probe ORDER BY n_terms DESC, id) AS rank FROM hit JOIN need USING (probe)) WHERE rank <= 20
""")
def entity_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a probe's entities (all of its terms) that a node names."""
    terms = S.probe_terms(_probes(spark, sf_dir))
    found = X.most_common(_nodes(spark, sf_dir), terms, 20).join(F.broadcast(terms.groupBy("probe").agg(F.count("*").alias("k"))), "probe")
    return found.select("probe", "id", F.round(F.col("n") / F.col("k"), 6).alias("score"), "rank")


_ALL = r"list_transform(regexp_extract_all(text, '(?:^|[^\p{L}\p{M}\p{N}_])([A-Z][A-Za-z0-9_-]+)', 1), lambda x: lower(x))"
_NAMES = f"list_distinct({_ALL})"
_FACETS = "['time', 'place', 'name', 'year']"


@query(rf"""
WITH {_POST}, {_CENTRES}, {_structured(32)},
nodes AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'semantic_state' ELSE 'chain_head' END AS kind, lower(source) AS topic, {_NAMES} AS entities, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_'']+')) AS t,
  DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS day FROM documents),
probes AS (SELECT item_id AS probe, lower(text) AS asked, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS q, list_filter({_ALL}, lambda x, i: list_position({_ALL}, x) = i)[1:4] AS hints, CASE WHEN item_id % 2 = 0 THEN ['event'] ELSE [] END AS kinds, CASE WHEN item_id % 3 = 0 THEN ['site1', 'news'] ELSE [] END AS topics,
  [{_FACETS}[1 + item_id % 4]] AS facets, ['any', 'at', 'before', 'after', 'between'][1 + item_id % 5] AS op, item_id % 10 >= 5 AS hard, make_date(2024, 1 + CAST(item_id % 12 AS INTEGER), 1) AS low FROM benchmark),
times AS (SELECT *, CAST(low + INTERVAL 1 MONTH AS DATE) - 1 AS first_ends, CAST(low + INTERVAL 3 MONTH AS DATE) - 1 AS high FROM probes),
c AS (SELECT item_id AS probe, vec_id AS id, round({_COSINE}, 6) AS dense FROM embeddings, centre, benchmark WHERE item_id % 10 = centre.probe),
dtop AS (SELECT probe, id, dense FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY dense DESC, id) AS n FROM c) WHERE n <= 32),
ent AS (SELECT probe, id, len(list_intersect(hints, entities)) / len(hints) AS entity FROM nodes, times WHERE list_has_any(hints, entities)),
etop AS (SELECT probe, id, entity FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY entity DESC, id) AS n FROM ent) WHERE n <= 32),
u AS (SELECT probe, id, max(d) AS d, max(s) AS s, max(e) AS e FROM (SELECT probe, id, dense AS d, 0.0 AS s, 0.0 AS e FROM dtop UNION ALL SELECT probe, id, 0.0, score, 0.0 FROM structured UNION ALL SELECT probe, id, 0.0, 0.0, entity FROM etop) GROUP BY probe, id),
x AS (SELECT *, CASE op WHEN 'any' THEN TRUE WHEN 'at' THEN day >= low AND day <= first_ends WHEN 'before' THEN day < low WHEN 'after' THEN day > first_ends ELSE day >= low AND day <= high END AS holds,
  least(0.12, CASE WHEN list_contains(kinds, kind) THEN 0.05 ELSE 0 END + CASE WHEN len(list_filter(topics, lambda h: contains(topic, h) OR contains(h, topic))) > 0 THEN 0.05 ELSE 0 END + CASE WHEN list_has_any(hints, entities) THEN 0.05 ELSE 0 END
    + CASE WHEN op <> 'any' AND NOT hard AND day <= first_ends AND day >= low THEN 0.06 ELSE 0 END) AS soft, CASE WHEN list_has_any(facets, t) THEN 1.0 ELSE 0.0 END AS facet FROM nodes, times),
y AS (SELECT x.*, d, s, e FROM u JOIN x USING (probe, id) WHERE NOT hard OR holds),
m AS (SELECT probe, id, term, mention FROM (SELECT probe, id, unnest(entities) AS mention FROM y) JOIN (SELECT probe, term FROM pterm WHERE r <= 12 UNION SELECT probe, unnest(hints) FROM times) USING (probe)),
g AS (SELECT probe, id, max(CASE WHEN term = mention THEN 1.0 WHEN length(term) > 1 AND contains(mention, term) THEN 0.8 WHEN length(mention) > 1 AND contains(term, mention) THEN 0.6 ELSE 0.0 END) AS exact FROM m GROUP BY 1, 2),
p AS (SELECT *, d / greatest(max(d) OVER w, 1e-12) AS dn, s / greatest(max(s) OVER w, 1e-12) AS sn, e / greatest(max(e) OVER w, 1e-12) AS en, regexp_matches(asked, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:who|what|which)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])') AS asks FROM y WINDOW w AS (PARTITION BY probe)),
b AS (SELECT probe, id, kind, round(greatest(0.45, 0.47 - CASE WHEN len(hints) > 0 THEN 0.08 ELSE 0 END - CASE WHEN op <> 'any' THEN 0.03 ELSE 0 END - CASE WHEN asks THEN 0.06 ELSE 0 END) * dn + (0.16 + CASE WHEN asks THEN 0.06 ELSE 0 END) * sn
  + (0.12 + CASE WHEN len(hints) > 0 THEN 0.08 ELSE 0 END) * en + 0.15 * coalesce(exact, 0) + (0.05 + CASE WHEN op <> 'any' THEN 0.03 ELSE 0 END) * facet + soft, 6) AS score, FALSE AS seeded FROM p LEFT JOIN g USING (probe, id)),
h AS (SELECT probe, id, kind, round(0.18 * len(list_intersect(q, t)) / greatest(1, len(q)) + 0.05 * facet + soft + 0.01, 6) AS score, TRUE AS seeded FROM x WHERE kind = 'chain_head' AND (NOT hard OR holds) AND probe NOT IN (SELECT probe FROM b WHERE kind = 'chain_head')),
hs AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS n FROM h) WHERE n <= 16),
z AS (SELECT *, row_number() OVER (PARTITION BY probe, kind = 'chain_head' ORDER BY score DESC, id) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM hs))
SELECT probe, id, kind, CAST(score AS DOUBLE) AS score, seeded, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM z WHERE n <= CASE WHEN kind = 'chain_head' THEN 3 ELSE 16 END
""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five channels with hard times, hints, seeded heads and quota: documents are nodes, items ask with their first terms and names."""
    lower = lambda c: F.array_distinct(F.transform(c, F.lower))
    names = lambda c: lower(F.regexp_extract_all(c, F.lit(r"(\b[A-Z][A-Za-z0-9_-]+)"), F.lit(1)))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    kind = F.when(F.col("doc_id") % 3 == 0, "event").when(F.col("doc_id") % 3 == 1, "semantic_state").otherwise("chain_head")
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", kind.alias("kind"), F.lower("source").alias("topic"), names(F.col("text")).alias("entities"), day.alias("starts"), day.alias("ends"))
    i, none = F.col("item_id"), F.expr("CAST(array() AS array<string>)")
    strings = lambda *v: F.array(*map(F.lit, v))
    terms = F.array_distinct(C.tokens(F.col("text")))
    low = F.make_date(F.lit(2024), (1 + i % 12).cast("int"), F.lit(1))
    asked = table(spark, sf_dir, "benchmark").select(
        i.alias("probe"), (i % 10).alias("c"), "text", F.slice(terms, 1, 4).alias("must"), F.slice(terms, 5, 8).alias("should"), F.slice(names(F.col("text")), 1, 4).alias("hints"), F.when(i % 2 == 0, strings("event")).otherwise(none).alias("kinds"),
        F.when(i % 3 == 0, strings("site1", "news")).otherwise(none).alias("topics"), F.array(F.element_at(strings("time", "place", "name", "year"), (1 + i % 4).cast("int"))).alias("facets"), F.element_at(strings("any", "at", "before", "after", "between"), (1 + i % 5).cast("int")).alias("op"),
        (i % 10 >= 5).alias("hard"), low.alias("low"), F.last_day(low).alias("first_ends"), F.date_sub(F.add_months(low, 3), 1).alias("high"), F.lit(16).alias("budget"),
    )
    probes = asked.join(_centres(spark, sf_dir).withColumnRenamed("probe", "c"), "c").drop("c")
    return S.hybrid(nodes, _vectors(spark, sf_dir).select("id", "v"), probes)


@query(r"""
WITH t AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS d FROM documents),
q AS (SELECT item_id AS probe, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS p FROM benchmark),
s AS (SELECT probe, id, round(len(list_intersect(p, d)) / greatest(1, len(p)), 6) AS score FROM t, q)
SELECT * FROM (SELECT probe, id, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""")
def lexical_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a probe's tokens that a node has; equal shares of one probe are equal numbers of tokens."""
    terms = S.probe_terms(_probes(spark, sf_dir))
    found = X.most_common(_nodes(spark, sf_dir), terms, 10).join(F.broadcast(terms.groupBy("probe").agg(F.count("*").alias("k"))), "probe")
    return found.select("probe", "id", F.round(F.col("n") / F.col("k"), 6).alias("score"), "rank")


@query(r"""
WITH m AS (SELECT DISTINCT id, lower(n) AS mention FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{M}\p{N}_])([A-Z][A-Za-z0-9_-]+)', 1)) AS n FROM documents)),
t AS (SELECT DISTINCT item_id AS probe, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS term FROM benchmark),
x AS (SELECT term, mention, CASE WHEN term = mention THEN 1.0 WHEN length(term) > 1 AND contains(mention, term) THEN 0.8 WHEN length(mention) > 1 AND contains(term, mention) THEN 0.6 END AS score FROM (SELECT DISTINCT term FROM t), (SELECT DISTINCT mention FROM m))
SELECT probe, id, CAST(max(score) AS DOUBLE) AS score FROM x JOIN t USING (term) JOIN m USING (mention) WHERE score > 0 GROUP BY 1, 2
""")
def exact_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the names in each document mention each probe's terms, all of them."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(\b[A-Z][A-Za-z0-9_-]+)"), F.lit(1)), F.lower))
    return S.mentioned(S.probe_terms(_probes(spark, sf_dir)), _nodes(spark, sf_dir).select("id", names.alias("names")))


@query(f"""
WITH {_CENTRES},
s AS (SELECT probe, vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings, centre),
top AS (SELECT probe, id, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s)
SELECT id, count(*) AS n_probes, max(score) AS score, max_by(probe, (score, -probe)) AS best_probe, round(max(61 / (60 + rank)) + least(0.08, 0.02 * (count(*) - 1)), 6) AS fused
FROM top WHERE rank <= 50 GROUP BY id
""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all probes merged by id: best score and its probe; best rank contribution 61 / (60 + rank), plus 0.02 for each further probe up to 0.08."""
    top = S.dense(_centres(spark, sf_dir), _vectors(spark, sf_dir), 50)
    return top.groupBy("id").agg(
        F.count("*").alias("n_probes"), F.max("score").alias("score"), F.max_by("probe", F.struct("score", -F.col("probe"))).alias("best_probe"),
        F.round(F.max(61 / (60 + F.col("rank"))) + F.least(F.lit(0.08), 0.02 * (F.count("*") - 1)), 6).alias("fused"),
    )


@query(f"""
WITH {_CENTRES},
s AS (SELECT probe, vec_id AS id, embedding, round({_COSINE}, 6) AS score FROM embeddings, centre),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 32),
pairs AS (SELECT a.probe, a.id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS c
  FROM top a JOIN top b ON a.probe = b.probe AND b.rank < a.rank)
SELECT probe, id, score, rank, round(coalesce((SELECT CASE WHEN max(c) IS NOT NULL THEN least(0.08, max(c) - 0.92) END FROM pairs p WHERE p.probe = top.probe AND p.id = top.id AND c >= 0.92), 0.0), 6) AS penalty FROM top
""")
def near_dup_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of a probe's 32 best: what its likeness to a better one costs. Pairs are within 32 rows."""
    top = S.dense(_centres(spark, sf_dir), _vectors(spark, sf_dir), 32).join(_vectors(spark, sf_dir).select("id", "v"), "id")
    better = top.select("probe", F.col("rank").alias("r"), F.col("v").alias("w"))
    seen = top.join(better, "probe").where("r < rank").select("probe", "id", F.round(C.cosine(F.col("v"), F.col("w")), 6).alias("c")).where("c >= 0.92")
    cost = seen.groupBy("probe", "id").agg(F.least(F.lit(0.08), F.max("c") - 0.92).alias("penalty"))
    return top.join(cost, ["probe", "id"], "left").select("probe", "id", "score", "rank", F.round(F.coalesce("penalty", F.lit(0.0)), 6).alias("penalty"))
