"""Evaluation queries: labels are judged answers, conversations are sessions with questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.operators import evaluation as E

from .registry import query, table

_JUDGED = """
judged AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'dynamic_conflict' WHEN 1 THEN 'static_conflict' ELSE 'conditional_conflict' END AS conflict_type, doc_id % 5 AS persona,
 CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 AND doc_id % 3 <> 2 THEN 0.5 ELSE 0.0 END AS accuracy, CAST(doc_id % 6 AS INT) AS support_rank, toxic AS handling FROM labels)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels")
    kind = F.element_at(F.array(*map(F.lit, E.KINDS)), (F.col("doc_id") % 3 + 1).cast("int"))
    said = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0.9).when(F.col("quality") == 1, 0.6).otherwise(0.1)
    return x.select(kind.alias("conflict_type"), (F.col("doc_id") % 5).alias("persona"), C.half_steps(said, kind == E.KINDS[2]).alias("accuracy"), (F.col("doc_id") % 6).cast("int").alias("support_rank"), F.col("toxic").alias("handling"))


_TABLE = _JUDGED + """, kk AS (SELECT unnest([2, 3, 5]) AS k), kinds AS (SELECT unnest(['dynamic_conflict', 'static_conflict', 'conditional_conflict']) AS conflict_type),
found AS (SELECT conflict_type, k, count(*) AS n, avg(accuracy) AS aa, avg(CASE WHEN support_rank BETWEEN 1 AND k THEN 1.0 ELSE 0.0 END) AS seh,
 avg(CASE WHEN support_rank BETWEEN 1 AND k THEN 1 / log2(support_rank + 1) ELSE 0.0 END) AS srs, avg(handling) AS ch FROM judged, kk GROUP BY 1, 2),
rows3 AS (SELECT conflict_type, k, coalesce(n, 0) AS n, aa, seh, srs, CASE WHEN conflict_type <> 'conditional_conflict' THEN ch END AS ch FROM kinds CROSS JOIN kk LEFT JOIN found USING (conflict_type, k))
"""


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


@query(f"WITH {_TABLE} SELECT conflict_type, k, n, round(aa, 6) AS aa, round(seh, 6) AS seh, round(srs, 6) AS srs, round(ch, 6) AS ch FROM rows3")
def metrics_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(E.metrics(_judged(spark, sf_dir), [2, 3, 5]), "aa", "seh", "srs", "ch")


@query(f"WITH {_TABLE} SELECT conflict_type, k, n, round(aa, 6) AS aa, round(seh, 6) AS seh, round(srs, 6) AS srs, round(ch, 6) AS ch FROM rows3 WHERE k = 3")
def metrics_table3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(E.metrics(_judged(spark, sf_dir), [3]), "aa", "seh", "srs", "ch")


@query(f"WITH {_TABLE} SELECT k, round(avg(aa), 6) AS aa, round(avg(seh), 6) AS seh, round(avg(srs), 6) AS srs, round(avg(ch), 6) AS ch FROM rows3 GROUP BY k")
def macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(E.macro(E.metrics(_judged(spark, sf_dir), [2, 3, 5])), "aa", "seh", "srs", "ch")


@query(f"""
WITH {_JUDGED}, g AS (SELECT conflict_type, sum(m * n) / sum(n) AS aa, sum(h * n) / sum(n) AS hit FROM (
 SELECT persona, conflict_type, avg(accuracy) AS m, avg(CASE WHEN support_rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END) AS h, count(*) AS n FROM judged GROUP BY 1, 2) GROUP BY 1)
SELECT round(max(hit - aa) FILTER (conflict_type = 'dynamic_conflict'), 6) AS dynamic, round(max(hit - aa) FILTER (conflict_type = 'static_conflict'), 6) AS static,
 round(max(hit - aa) FILTER (conflict_type = 'conditional_conflict'), 6) AS conditional, round(sum(hit - aa) / 3, 6) AS average FROM g
""")
def eug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far accuracy lags behind support: personas' means weighed by their questions, then a gap for each kind."""
    own = _judged(spark, sf_dir).groupBy("persona", "conflict_type").agg(F.avg("accuracy").alias("m"), F.avg(F.col("support_rank").between(1, 3).cast("double")).alias("h"), F.count("*").alias("n"))
    gap = own.groupBy("conflict_type").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n") - F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("gap"))
    of = lambda kind, name: F.round(F.max(F.when(F.col("conflict_type") == kind, F.col("gap"))), 6).alias(name)
    return gap.agg(*(of(k, k.split("_")[0]) for k in E.KINDS), F.round(F.sum("gap") / 3, 6).alias("average"))


@query(f"""
WITH {_JUDGED}, g AS (SELECT conflict_type, count(*) AS total, count_if(accuracy < 1) AS failed, count_if(accuracy < 1 AND NOT support_rank BETWEEN 1 AND 3) AS retrieval, count_if(accuracy < 1 AND support_rank BETWEEN 1 AND 3) AS utilisation FROM judged GROUP BY 1)
SELECT *, CAST(0 AS BIGINT) AS missing, round(coalesce(retrieval / nullif(failed, 0), 0), 6) AS retrieval_share, round(coalesce(utilisation / nullif(failed, 0), 0), 6) AS utilisation_share, round(failed / total, 6) AS failed_share FROM g
""")
def failure_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(E.failures(_judged(spark, sf_dir), "conflict_type"), "retrieval_share", "utilisation_share", "failed_share")


@query("""
WITH q AS (SELECT conv_id, turn AS question, turn AS session FROM conversations WHERE role = 'user'), e AS (SELECT conv_id, turn AS session FROM conversations WHERE role = 'assistant')
SELECT conv_id, question, session, (SELECT count(*) FROM e WHERE e.conv_id = q.conv_id AND e.session <= q.session) AS visible FROM q
""")
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("session"))
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("question"), F.col("turn").alias("session"))
    return E.visible_evidence(e, q, ["conv_id"])


@query("""
WITH log AS (SELECT conv_id, turn, 'log' AS kind FROM conversations), res AS (SELECT conv_id, turn, 'result' AS kind FROM conversations WHERE turn % 2 = 0),
m AS (SELECT conv_id, turn, kind FROM res UNION ALL SELECT conv_id, turn, kind FROM log WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM res))
SELECT conv_id, count(*) AS sessions, count_if(kind = 'log') AS backfilled FROM m GROUP BY conv_id
""")
def backfill_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results win; sessions that only the log has are filled in."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    res = c.where("turn % 2 = 0").withColumn("kind", F.lit("result"))
    fill = c.withColumn("kind", F.lit("log")).join(res.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    return res.unionByName(fill).groupBy("conv_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("kind") == "log").alias("backfilled"))


@query("""
SELECT l_suppkey AS persona, count(*) AS calls, round(sum(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity / 1e6 * CASE l_returnflag WHEN 'A' THEN 150.0 ELSE 600.0 END END), 6) AS cost, count_if(l_returnflag = 'N') AS unpriced FROM lineitem GROUP BY 1
""")
def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls priced by a table of models; a model without a price costs nothing known."""
    prices = spark.createDataFrame([("A", 150.0), ("R", 600.0)], "l_returnflag string, price double")
    df = table(spark, sf_dir, "lineitem").join(F.broadcast(prices), "l_returnflag", "left")
    return df.groupBy(F.col("l_suppkey").alias("persona")).agg(F.count("*").alias("calls"), F.round(F.sum(F.col("l_quantity") / 1e6 * F.col("price")), 6).alias("cost"), F.count_if(F.col("price").isNull()).alias("unpriced"))
