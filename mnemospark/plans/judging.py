"""Queries that judge answers by rules: documents answer items, labels and events stand for judgements and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.operators import answers as A
from mnemospark.operators import evaluation as E
from mnemospark.operators import judging as J
from mnemospark.operators import texts as X
from mnemospark.operators import times as T

from .evaluation import _JUDGED, _judged
from .registry import query, table




@query(r"""
WITH s AS (SELECT doc_id, item_id, list_filter(string_split(regexp_replace(lower(d.text), '[^a-z ]', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS a, list_filter(string_split(regexp_replace(lower(b.text), '[^a-z ]', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS b
  FROM documents d JOIN benchmark b ON b.item_id IN (d.doc_id % (SELECT count(*) FROM benchmark), (d.doc_id + 7) % (SELECT count(*) FROM benchmark))),
ca AS (SELECT doc_id, item_id, w, count(*) AS n FROM (SELECT doc_id, item_id, unnest(a) AS w FROM s) GROUP BY 1, 2, 3), cb AS (SELECT doc_id, item_id, w, count(*) AS n FROM (SELECT doc_id, item_id, unnest(b) AS w FROM s) GROUP BY 1, 2, 3),
c AS (SELECT doc_id, item_id, sum(least(ca.n, cb.n)) AS n FROM ca JOIN cb USING (doc_id, item_id, w) GROUP BY 1, 2)
SELECT doc_id, max(CASE WHEN array_to_string(a, ' ') = array_to_string(b, ' ') THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_match, round(max(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END ELSE 2.0 * coalesce(n, 0) / (len(a) + len(b)) END), 6) AS token_f1 FROM s LEFT JOIN c USING (doc_id, item_id) GROUP BY 1
""")
def exact_and_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match and token F1 of each document, read as plain words, against two items."""
    b = table(spark, sf_dir, "benchmark")
    n, letters = b.count(), lambda c: F.regexp_replace(F.lower(c), "[^a-z ]", " ")
    d = table(spark, sf_dir, "documents")
    pairs = d.select("doc_id", F.explode(F.array(F.col("doc_id") % n, (F.col("doc_id") + 7) % n)).alias("item_id"))
    refs = pairs.join(b, "item_id").select(F.col("doc_id").alias("id"), letters("text").alias("reference"))
    return J.against_references(d.select(F.col("doc_id").alias("id"), letters("text").alias("text")), refs).select(F.col("id").alias("doc_id"), "exact_match", F.round("token_f1", 6).alias("token_f1"))


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(translate({}, '_-', '  ')), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"
_SAID = "'It changed from ' || left(text, 12) || CASE doc_id % 4 WHEN 0 THEN ' to tea.' WHEN 1 THEN '; a Conflict!' WHEN 2 THEN ' and was UPDATED: previously so, now thus' ELSE ' mis-match' END"


def _said() -> F.col:
    end = F.element_at(F.array(*map(F.lit, (" to tea.", "; a Conflict!", " and was UPDATED: previously so, now thus", " mis-match"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return F.concat(F.lit("It changed from "), F.left("text", F.lit(12)), end)


@query(f"""
WITH a AS (SELECT doc_id, {_SAID} AS answer, CASE doc_id % 3 WHEN 0 THEN 'dynamic_conflict' WHEN 1 THEN 'static_conflict' ELSE 'conditional_conflict' END AS conflict_type, CASE doc_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS credit FROM documents),
n AS (SELECT *, {_NORMAL.format('answer')} AS s FROM a),
f AS (SELECT *, (contains(s, 'change') OR contains(s, 'update') OR contains(s, 'switched')) AND ((contains(s, 'from') AND contains(s, 'to')) OR (contains(s, 'now') AND (contains(s, 'previously') OR contains(s, 'used to') OR contains(s, 'before')))) AS ordered,
  contains(s, 'inconsisten') OR contains(s, 'conflict') OR contains(s, 'contradict') OR contains(s, 'cannot confirm') OR contains(s, 'uncertain') OR contains(s, 'mismatch') AS conflict FROM n)
SELECT doc_id, conflict_type, CAST(CASE WHEN conflict_type = 'conditional_conflict' THEN CASE WHEN credit >= 0.5 THEN 1.0 ELSE 0.0 END ELSE credit END AS DOUBLE) AS accuracy, CAST(CASE conflict_type WHEN 'dynamic_conflict' THEN credit >= 0.5 AND ordered WHEN 'static_conflict' THEN conflict END AS INTEGER) AS handling FROM f
""")
def rule_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules make of answers with known credit: accuracy, and whether updates or conflicts are told."""
    kind = F.element_at(F.array(*map(F.lit, E.KINDS)), (F.col("doc_id") % 3 + 1).cast("int"))
    credit = F.when(F.col("doc_id") % 5 == 0, 0.0).when(F.col("doc_id") % 5 == 1, 0.5).otherwise(1.0)
    df = table(spark, sf_dir, "documents").select("doc_id", kind.alias("conflict_type"), J.by_rule(kind, credit, _said()).alias("j"))
    return df.select("doc_id", "conflict_type", "j.accuracy", "j.handling")


@query(f"""
WITH {_JUDGED}, kk AS (SELECT unnest([1, 3, 5, 10]) AS k), kinds AS (SELECT unnest(['dynamic_conflict', 'static_conflict', 'conditional_conflict']) AS conflict_type),
f AS (SELECT conflict_type, k, count(*) AS questions, avg(CASE WHEN support_rank BETWEEN 1 AND k THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN support_rank BETWEEN 1 AND k THEN 1 / log2(support_rank + 1) ELSE 0.0 END) AS rank_score FROM judged, kk WHERE conflict_type <> 'static_conflict' GROUP BY 1, 2)
SELECT conflict_type, k, coalesce(questions, 0) AS questions, round(coalesce(hit, 0), 6) AS hit, round(coalesce(rank_score, 0), 6) AS rank_score FROM kinds CROSS JOIN kk LEFT JOIN f USING (conflict_type, k)
""")
def white_box_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support within several windows; a kind without questions has zeros, not nulls."""
    out = J.white_box_summary(_judged(spark, sf_dir).where("conflict_type <> 'static_conflict'"), [1, 3, 5, 10])
    return out.select("conflict_type", "k", "questions", F.round("hit", 6).alias("hit"), F.round("rank_score", 6).alias("rank_score"))


@query(r"""
WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS units, array_to_string(list(text ORDER BY turn), chr(10)) AS said FROM conversations GROUP BY 1), w AS (SELECT conv_id, units, said, regexp_extract_all(lower(said), '[a-z0-9'']+') AS words FROM t),
c AS (SELECT conv_id, units, said, [words[1] || ' ' || words[2], words[len(words)], 'no such concept'] AS concepts FROM w), n AS (SELECT conv_id, concepts, units, array_to_string(regexp_extract_all(lower(said), '[a-z0-9'']+'), ' ') AS flat, list_transform(units, lambda u: array_to_string(regexp_extract_all(lower(u), '[a-z0-9'']+'), ' ')) AS plain FROM c)
SELECT conv_id, round(CASE WHEN conv_id % 4 = 0 THEN 0.25 ELSE len(list_filter(concepts, lambda c: contains(flat, c))) / 3 END, 6) AS recall, round(CASE WHEN conv_id % 8 = 0 THEN 0.75 ELSE len(list_filter(plain, lambda u: contains(u, concepts[1]) OR contains(u, concepts[2]))) / len(units) END, 6) AS precision,
  CASE WHEN conv_id % 8 = 0 THEN 'llm' WHEN conv_id % 4 = 0 THEN 'mixed' ELSE 'lexical_fallback' END AS judge FROM n
""")
def proactive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of concepts over a conversation's turns, where a judge left them open."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("units"))
    words = F.split(J.alnum(F.array_join("units", "\n")), " ")
    rows = t.select(
        "conv_id", "units", F.array(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))), F.element_at(words, -1), F.lit("no such concept")).alias("concepts"), F.lit("").alias("answer"),
        F.when(F.col("conv_id") % 4 == 0, 0.25).alias("judged_recall"), F.when(F.col("conv_id") % 8 == 0, 0.75).alias("judged_precision"),
    )
    return J.proactive(rows).select("conv_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "judge")


@query("""
WITH m AS (SELECT conv_id, list(text ORDER BY turn) AS memories FROM conversations WHERE role <> 'system' GROUP BY 1), q AS (SELECT DISTINCT conv_id % 10 AS persona, conv_id FROM conversations)
SELECT persona, count_if(len(coalesce(memories, [])) < 5) AS short, count(*) AS questions, CAST(coalesce(sum(least(3, len(memories))), 0) AS BIGINT) AS shown FROM q LEFT JOIN m USING (conv_id) GROUP BY 1
""".replace("count_if(len(coalesce(memories, [])) < 5)", "CAST(count_if(len(coalesce(memories, [])) < 5) AS BIGINT)"))
def short_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose stored memories are fewer than the five that are judged, and how many of the first three are shown."""
    t = table(spark, sf_dir, "conversations")
    m = t.where("role <> 'system'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("memories"))
    q = t.select((F.col("conv_id") % 10).alias("persona"), "conv_id").distinct().join(m, "conv_id", "left")
    return q.groupBy("persona").agg(J.short_windows(F.col("memories"), 5).alias("short"), F.count("*").alias("questions"), F.coalesce(F.sum(F.size(J.positions(F.coalesce("memories", F.expr("CAST(array() AS array<string>)")), 3))), F.lit(0)).alias("shown"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_id % 5 AS k FROM events), c AS (SELECT k, user_id, strftime(CAST(ts AS DATE) - CASE k WHEN 0 THEN 2 ELSE 1 END, '%Y-%m-%d') AS d FROM e WHERE k < 2),
g AS (SELECT user_id, k, d, count(*) AS n FROM c GROUP BY 1, 2, 3), b AS (SELECT user_id, max(CASE WHEN k = 0 AND r = 1 THEN d END) AS two, max(CASE WHEN k = 1 AND r = 1 THEN d END) AS yes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY n DESC, d) AS r FROM g) GROUP BY 1),
u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id AS probe, CASE WHEN two IS NULL AND yes IS NULL THEN 'We met 2 days ago and Yesterday.' WHEN two IS NULL OR yes IS NULL THEN 'The retrieved evidence does not provide enough unambiguous absolute-time information to answer reliably.' ELSE 'We met ' || two || ' and ' || yes || '.' END AS corrected, two IS NULL OR yes IS NULL AS residual FROM u LEFT JOIN b USING (user_id)
""")
def corrected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative times in answers give way to what most of a user's memories say they stand for, numbers in either form."""
    e = table(spark, sf_dir, "events")
    said = F.element_at(F.array(*map(F.lit, ("two days ago", "yesterday", "Friday", "a few days ago", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    m = T.with_times(e.select(F.col("user_id").alias("probe"), said.alias("said"), "ts"), F.col("said"), F.col("ts")).select("probe", "said", "t.*")
    answers = e.select(F.col("user_id").alias("probe")).distinct().withColumn("answer", F.lit("We met 2 days ago and Yesterday."))
    return J.corrected(answers, J.time_mappings(m)).select("probe", "corrected", "residual")


@query(r"""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, l_linenumber % 4 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, CASE k WHEN 0 THEN b - a WHEN 1 THEN b - (a + 3) WHEN 2 THEN (year(b) - year(a)) * 12 + month(b) - month(a) ELSE year(b) - year(a) END AS low, CASE k WHEN 1 THEN b + 2 - a ELSE 0 END AS high FROM x)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN CASE WHEN b >= a THEN low || CASE WHEN low = 1 THEN ' day' ELSE ' days' END END WHEN 1 THEN CASE WHEN b >= a + 3 THEN 'about ' || low || CASE WHEN low = 1 THEN ' day' ELSE ' days' END || ' to ' || high || ' days' END
  WHEN 2 THEN CASE WHEN low >= 0 THEN 'about ' || low || CASE WHEN low = 1 THEN ' month' ELSE ' months' END END ELSE CASE WHEN low >= 0 AND b >= a THEN low || CASE WHEN low = 1 THEN ' year' ELSE ' years' END END END AS duration,
  k <> 3 AS grounded FROM r
""")
def computed_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations from endpoints that are days, ranges or months; and whether the quote that gave them stands in the context."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("a"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("b")).join(orders, "l_orderkey")
    day, k = lambda c, n=0: F.date_format(F.date_add(F.col(c).cast("date"), n), "yyyy-MM-dd"), F.col("l_linenumber") % 4
    starts = F.when(k == 1, F.concat(day("a"), F.lit(" to "), day("a", 3))).when(k == 2, F.date_format("a", "yyyy-MM")).otherwise(day("a"))
    ends = F.when(k == 1, F.concat(day("b"), F.lit(" to "), day("b", 2))).otherwise(day("b"))
    unit = F.when(k < 2, "days").when(k == 2, "months").otherwise("years")
    quote = F.when(k == 3, "it came  late ").otherwise(F.concat(F.lit("It CAME on\n"), day("b")))
    return df.select("l_orderkey", "l_linenumber", J.computed_duration(starts, ends, unit).alias("duration"), J.grounded(quote, F.concat(F.lit("we know it came on "), day("b"))).alias("grounded"))
