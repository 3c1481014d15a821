"""Queries on texts, ids and times: hashing, gates, classifiers, scores against references, time normalising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.operators import texts as X
from mnemospark.operators import times as T

from .registry import query, table


@query("""
SELECT doc_id, 'node_' || substr(sha256(concat_ws('␟', source, lang, CAST(doc_id AS VARCHAR))), 1, 24) AS node_id, 'text_' || substr(sha256(text), 1, 24) AS text_id FROM documents
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.stable_id("node", F.col("source"), F.col("lang"), F.col("doc_id")).alias("node_id"), C.stable_id("text", F.col("text")).alias("text_id"))


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS term FROM documents),
h AS (SELECT doc_id, CAST(('0x' || substr(sha256(term), 1, 8)) AS BIGINT) % 64 AS i, CASE WHEN CAST(('0x' || substr(sha256(term), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT doc_id, i, CAST(sum(s) AS BIGINT) AS x FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM v GROUP BY 1)
SELECT doc_id, i, round(x / size, 6) AS x FROM v JOIN n USING (doc_id) WHERE x <> 0
""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero components of each text's hashed vector. Each distinct token is hashed once a document."""
    return X.hash_embedding(table(spark, sf_dir, "documents").select("doc_id", "text"), 64)


@query(r"""
WITH t AS (SELECT *, lower(regexp_replace(trim(text), '[\s!,.?~]+', '', 'g')) AS n, lower(trim(text)) AS l FROM conversations)
SELECT conv_id, count(*) AS turns, count_if(NOT (trim(text) = '' OR n IN ('hi', 'hello', 'hey', 'thanks', 'thankyou', 'ok', 'okay', 'bye', 'goodbye', 'yes', 'no', 'yeah', 'nope') OR length(n) <= 1
  OR regexp_matches(l, '^(please open |open settings|click |run command |delete this |show me )'))) AS informative FROM t GROUP BY conv_id
""")
def write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of a conversation are worth remembering."""
    df = table(spark, sf_dir, "conversations")
    return df.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(X.informative(F.col("text"))).alias("informative"))


@query(r"""
WITH t AS (SELECT source, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents)
SELECT source, CASE WHEN list_has_any(w, ['travel', 'trip', 'journey', 'beijing', 'shanghai']) THEN 'travel' WHEN list_has_any(w, ['health', 'doctor', 'hospital', 'pain']) OR len([x FOR x IN w IF starts_with(x, 'allerg')]) > 0 THEN 'health'
 WHEN list_has_any(w, ['food', 'eat', 'spicy', 'restaurant']) THEN 'food_preference' WHEN list_has_any(w, ['work', 'job', 'company', 'project']) THEN 'work' WHEN list_has_any(w, ['friend', 'family', 'marry', 'relationship']) THEN 'relationship'
 WHEN list_has_any(w, ['school', 'university', 'study', 'degree']) THEN 'education' WHEN list_has_any(w, ['plan', 'goal', 'will', 'intend']) THEN 'long_term_plan' ELSE 'general' END AS topic, count(*) AS n FROM t GROUP BY 1, 2
""")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", X.topic(F.col("text")).alias("topic")).agg(F.count("*").alias("n"))


@query(r"""
WITH r AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') AS w FROM benchmark), rt AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(w) AS term FROM r) GROUP BY 1, 2),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') AS w FROM documents), dt AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
m AS (SELECT doc_id, item_id, CAST(sum(least(rt.c, dt.c)) AS BIGINT) AS common FROM rt JOIN dt USING (term) GROUP BY 1, 2)
SELECT doc_id, round(max(2.0 * common / (len(d.w) + len(r.w))), 6) AS f1 FROM m JOIN d USING (doc_id) JOIN r USING (item_id) GROUP BY doc_id
""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best token F1, with multiplicities, of each document against all references."""
    return X.token_f1(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), "text")).select(F.col("id").alias("doc_id"), F.round("f1", 6).alias("f1"))


@query(r"""
WITH r AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS w FROM documents),
s AS (SELECT doc_id, len(list_intersect(d.w, r.w)) AS c, len(d.w) AS p, len(r.w) AS q FROM d, r)
SELECT doc_id, round(max(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (p + q) END), 6) AS f1 FROM s WHERE c > 0 GROUP BY doc_id
""")
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best F1 of each document's distinct tokens against those of all references."""
    own, refs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), "text")
    return X.token_f1(own, refs, distinct=True).select(F.col("id").alias("doc_id"), F.round("f1", 6).alias("f1"))


@query("""
WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'date' ELSE 'datetime' END AS prec, ts FROM events),
b AS (SELECT event_id, prec, CASE prec WHEN 'year' THEN date_trunc('year', ts) WHEN 'month' THEN date_trunc('month', ts) WHEN 'date' THEN date_trunc('day', ts) ELSE ts END AS s FROM p)
SELECT event_id, prec, CAST(s AS TIMESTAMP) AS s, CAST(CASE prec WHEN 'year' THEN s + INTERVAL 1 YEAR - INTERVAL 1 SECOND WHEN 'month' THEN s + INTERVAL 1 MONTH - INTERVAL 1 SECOND WHEN 'date' THEN s + INTERVAL 1 DAY - INTERVAL 1 SECOND ELSE s END AS TIMESTAMP) AS e FROM b
""")
def precision_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    prec = F.element_at(F.array(*map(F.lit, ("year", "month", "date", "datetime"))), (F.col("event_id") % 4 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", prec.alias("prec"), "ts")
    return df.select("event_id", "prec", C.begins(F.col("ts"), F.col("prec")).alias("s"), C.ends(F.col("ts"), F.col("prec")).alias("e"))


@query("""
WITH x AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%B %-d, %Y') WHEN 2 THEN strftime(ts, '%-d %B %Y') WHEN 3 THEN strftime(ts, '%B %Y') WHEN 4 THEN strftime(ts, '%Y') ELSE strftime(ts, '%Y-%m') END AS said FROM events)
SELECT event_id, said, CASE event_id % 6 WHEN 4 THEN 'year' WHEN 3 THEN 'month' WHEN 5 THEN 'month' ELSE 'date' END AS precision,
 CAST(CASE WHEN event_id % 6 = 4 THEN date_trunc('year', ts) WHEN event_id % 6 IN (3, 5) THEN date_trunc('month', ts) ELSE date_trunc('day', ts) END AS VARCHAR) AS starts FROM x
""".replace("AS VARCHAR) AS starts", "AS DATE)::VARCHAR AS starts"))
def time_normalize_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute dates written in six ways, read back as a day, month or year."""
    ways = ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMMM yyyy", "yyyy", "yyyy-MM")
    said = F.element_at(F.array(*(F.date_format("ts", w) for w in ways)), (F.col("event_id") % 6 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    df, read = C.once(df, "t", T.absolute(F.col("said"))), F.col("t")
    return df.select("event_id", "said", read["precision"].alias("precision"), read["starts"].alias("starts"))


@query("""
WITH x AS (SELECT event_id, CAST(ts AS DATE) AS a, CASE event_id % 8 WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' WHEN 2 THEN '3 days ago' WHEN 3 THEN '2 weeks ago' WHEN 4 THEN 'last month' WHEN 5 THEN 'next year' WHEN 6 THEN 'a few days ago' ELSE '5 months later' END AS said FROM events)
SELECT event_id, said, CASE WHEN said LIKE '%few%' THEN 'unresolved' ELSE 'resolved_relative' END AS status,
 CAST(CASE said WHEN 'today' THEN a WHEN 'yesterday' THEN a - 1 WHEN '3 days ago' THEN a - 3 WHEN '2 weeks ago' THEN date_trunc('week', a) - INTERVAL 14 DAY WHEN 'last month' THEN date_trunc('month', a) - INTERVAL 1 MONTH WHEN 'next year' THEN date_trunc('year', a) + INTERVAL 1 YEAR WHEN '5 months later' THEN date_trunc('month', a) + INTERVAL 5 MONTH END AS DATE)::VARCHAR AS starts FROM x
""")
def time_normalize_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = ("today", "yesterday", "3 days ago", "2 weeks ago", "last month", "next year", "a few days ago", "5 months later")
    said = F.element_at(F.array(*map(F.lit, ways)), (F.col("event_id") % 8 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", said.alias("said"), F.to_date("ts").alias("anchor"))
    df, read = T.with_times(df, F.col("said"), F.col("anchor")), F.col("t")
    return df.select("event_id", "said", read["status"].alias("status"), read["starts"].alias("starts"))


@query(r"""
SELECT l_orderkey, l_linenumber, CASE WHEN d < 14 THEN d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END WHEN d < 60 THEN CAST(floor(d / 7.0 + 0.5) AS BIGINT) || ' weeks' ELSE CAST(floor(d / 30.0 + 0.5) AS BIGINT) || ' months' END AS label
FROM (SELECT l_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
""")
def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.datediff("l_shipdate", "o_orderdate"))
    label = F.when(d < 14, F.concat(d.cast("string"), F.when(d == 1, " day").otherwise(" days"))).when(d < 60, F.concat(F.floor(d / 7.0 + 0.5).cast("string"), F.lit(" weeks"))).otherwise(F.concat(F.floor(d / 30.0 + 0.5).cast("string"), F.lit(" months")))
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", label.alias("label"))


@query(r"""
SELECT item_id, answer, len(list_distinct([y FOR y IN [trim(x) FOR x IN string_split_regex(answer, '\|\||\n|;')] || [trim(answer)] IF y <> ''])) AS variants FROM (SELECT item_id, replace(text, '. ', ';') AS answer FROM benchmark)
""")
def answer_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct answers a reference allows: the whole and its parts."""
    answer = F.replace("text", F.lit(". "), F.lit(";"))
    return table(spark, sf_dir, "benchmark").select("item_id", answer.alias("answer")).select("item_id", "answer", F.size(X.variants(F.col("answer"))).cast("long").alias("variants"))
