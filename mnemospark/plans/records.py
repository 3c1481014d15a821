"""Queries on records: facts stated in turns, aliases, transplanted questions, repaired references, token lengths, streams of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.operators import texts as X
from mnemospark.operators.answers import similarity_column
from mnemospark.streaming import folds

from .registry import query, table
from .stateful import _event_stream, _stream_dir


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '(?s)^\s*(\S+)', CASE WHEN turn % 2 = 0 THEN 'I LIKE \1' ELSE 'Can''t eat \1' END) AS said FROM conversations),
m AS (SELECT conv_id, turn, unnest([struct_pack(key := 'preference', value := TRUE, object := trim(regexp_extract(said, '(?i)\bI\s+(?:like|love)\s*([^,.!?]+)', 1))),
 struct_pack(key := 'preference', value := FALSE, object := trim(regexp_extract(said, '(?i)\bI\s+(?:dislike|hate)\s*([^,.!?]+)', 1))),
 struct_pack(key := 'food_restriction', value := FALSE, object := trim(regexp_extract(said, '(?i)\b(?:can''t eat|cannot eat|avoid)\s*([^,.!?]+)', 1))),
 struct_pack(key := 'allergy', value := TRUE, object := trim(regexp_extract(said, '(?i)\ballergic to\s*([^,.!?]+)', 1)))]) AS f FROM t)
SELECT conv_id, turn, f.key AS key, f.value AS value, sha256(f.object) AS object FROM m WHERE f.object <> ''
""")
def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by pattern, in any case; each turn is read as if it began with what its speaker likes or can't eat."""
    said = F.regexp_replace("text", F.lit(r"(?s)^\s*(\S+)"), F.when(F.col("turn") % 2 == 0, "I LIKE $1").otherwise("Can't eat $1"))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(X.stated_facts(said)))
    return df.where("object <> ''").select("conv_id", "turn", "key", "value", F.sha2("object", 256).alias("object"))


@query("""
WITH a AS (SELECT source AS alias, doc_id, CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS precedence, lang FROM documents) SELECT alias, arg_max(lang, (precedence, -doc_id)) AS kind, arg_max(doc_id, (precedence, -doc_id)) AS entity, count(*) AS seen FROM a GROUP BY 1
""")
def alias_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind and entity an alias stands for: the kind that precedes others, then the first seen."""
    rank = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "fr", 2).otherwise(1)
    by = F.struct(rank, -F.col("doc_id"))
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("alias")).agg(F.max_by("lang", by).alias("kind"), F.max_by("doc_id", by).alias("entity"), F.count("*").alias("seen"))


@query("""
SELECT a.conv_id, a.turn, coalesce(b.text, a.text) = a.text AS own FROM conversations a LEFT JOIN (SELECT conv_id, turn, text || '?' AS text FROM conversations WHERE turn % 3 = 0) b ON a.conv_id = b.conv_id AND a.turn = b.turn
""")
def question_transplant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of another chain replace those of the same session."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = a.where("turn % 3 = 0").select("conv_id", "turn", F.concat("text", F.lit("?")).alias("other"))
    return a.join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.coalesce("other", "text") == F.col("text")).alias("own"))


@query("""
WITH p AS (SELECT l_orderkey AS e, l_linenumber AS q, l_quantity AS prediction FROM lineitem WHERE l_linestatus = 'F'), t AS (SELECT l_orderkey AS e, l_linenumber AS q, l_tax AS trace FROM lineitem WHERE l_returnflag <> 'N')
SELECT e, count(*) AS pairs, round(sum(prediction * trace), 6) AS total FROM p JOIN t USING (e, q) GROUP BY 1
""")
def prediction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    p = l.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("q"), "l_quantity")
    t = l.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("q"), "l_tax")
    return p.join(t, ["e", "q"]).groupBy("e").agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("l_quantity") * F.col("l_tax")), 6).alias("total"))


@query(r"""
SELECT conv_id, count(*) AS turns, CAST(sum(n) AS BIGINT) AS tokens, count_if(n > 0) AS valid, count_if(n < 20) AS short FROM (SELECT conv_id, len([x FOR x IN string_split_regex(trim(text), '\s+') IF x <> '']) AS n FROM conversations) GROUP BY 1
""")
def dialogue_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    return table(spark, sf_dir, "conversations").select("conv_id", n.alias("n")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("valid"), F.count_if(F.col("n") < 20).alias("short"))


@query("""
WITH s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS said, list(text ORDER BY turn DESC) FILTER (role = 'user') AS latest FROM conversations GROUP BY 1)
SELECT conv_id, len(list_distinct(latest[1:3])) AS probes, sha256(coalesce(latest[1], '')) AS newest FROM s
""")
def retrieval_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three distinct probes of a dialogue: the user's latest turns."""
    own = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct(-F.col("turn"), "text"))), True), lambda x: x["text"])
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(own.alias("latest"))
    return s.select("conv_id", F.size(F.array_distinct(F.slice("latest", 1, 3))).cast("long").alias("probes"), F.sha2(F.coalesce(F.get("latest", F.lit(0)), F.lit("")), 256).alias("newest"))


@query(r"""
WITH k AS (SELECT p_partkey AS id, lower(regexp_replace('Part-' || p_partkey || '/' || (p_partkey % 7), '[^A-Za-z0-9]', '', 'g')) AS norm FROM part), asked AS (SELECT l_orderkey, l_linenumber, lower(regexp_replace('PART ' || l_partkey || ' ' || (l_partkey % 7), '[^A-Za-z0-9]', '', 'g')) AS norm FROM lineitem),
u AS (SELECT norm, min(id) AS id, count(*) AS n FROM k GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN id END AS repaired FROM asked LEFT JOIN u USING (norm)
""")
def repaired_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References matched by their letters and digits alone, where that is unique."""
    plain = lambda *c: F.lower(F.regexp_replace(F.concat(*c), "[^A-Za-z0-9]", ""))
    key = lambda c, head, gap: plain(F.lit(head), F.col(c).cast("string"), F.lit(gap), (F.col(c) % 7).cast("string"))
    known = table(spark, sf_dir, "part").groupBy(key("p_partkey", "Part-", "/").alias("norm")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key("l_partkey", "PART ", " ").alias("norm"))
    return asked.join(known, "norm", "left").select("l_orderkey", "l_linenumber", F.when(F.col("n") == 1, F.col("id")).alias("repaired"))


@query()
def alias_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike neighbouring nation names of a region are."""
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.lead("n_name").over(w).alias("b")).where("b IS NOT NULL")
    return n.select("a", "b", F.round(similarity_column(F.lower("a"), F.lower("b")), 6).alias("likeness"))


@query(r"""
WITH j AS (SELECT user_id, event_id, value / 100 AS accuracy, event_id % 7 AS rank, event_type = (SELECT min(event_type) FROM events) AS strict FROM events)
SELECT user_id, event_id, CASE WHEN accuracy >= 0.75 THEN 1.0 WHEN accuracy >= 0.25 AND NOT strict THEN 0.5 ELSE 0.0 END AS accuracy, CAST(CASE WHEN rank BETWEEN 1 AND 5 THEN rank ELSE 0 END AS BIGINT) AS rank FROM j
""")
def judge_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    kind = ev.agg(F.min("event_type")).first()[0]
    rank = F.col("event_id") % 7
    return ev.select("user_id", "event_id", C.half_steps(F.col("value") / 100, F.col("event_type") == kind).alias("accuracy"), F.when(rank.between(1, 5), rank).otherwise(0).cast("long").alias("rank"))


@query("""
WITH last AS (SELECT max(ts) AS m FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g),
w AS (SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS events FROM s GROUP BY user_id, n)
SELECT user_id, start, events FROM w, last WHERE stop + INTERVAL 30 MINUTE <= m
""")
def stream_sessions_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from a stream: those the watermark has closed."""
    e = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = folds.run_to_table(spark, folds.sessions(e, late="0 seconds"), "append", _stream_dir(spark))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
