"""Aggregates: rates, roll-ups, percentiles, deviations over runs, histograms, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table


@query("""
SELECT l_returnflag AS provider, count(*) AS calls, count_if(l_linestatus = 'F') AS failures, CAST(sum(l_quantity) AS BIGINT) AS tokens, min(l_shipdate) AS first, max(l_shipdate) AS last,
  round(CASE WHEN epoch(max(l_shipdate)) > epoch(min(l_shipdate)) THEN count(*) / ((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 60.0) ELSE 0 END, 9) AS per_minute FROM lineitem GROUP BY 1
""")
def rate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_seconds(F.max("l_shipdate").cast("timestamp")) - F.unix_seconds(F.min("l_shipdate").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("l_linestatus") == "F").alias("failures"), F.sum("l_quantity").cast("long").alias("tokens"),
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.round(F.when(seconds > 0, F.count("*") / (seconds / 60.0)).otherwise(0.0), 9).alias("per_minute"),
    )


@query("""
SELECT coalesce(lang, 'overall') AS category, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, round(coalesce(stddev_samp(n_chars), 0), 6) AS std_chars FROM documents GROUP BY ROLLUP (lang)
""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.coalesce(F.stddev_samp("n_chars"), F.lit(0.0)), 6).alias("std_chars")).withColumn("category", F.coalesce("lang", F.lit("overall"))).drop("lang")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def trace_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("value", [0.5, 0.95])
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), p.alias("p")).select("event_type", "n", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


@query("""
WITH runs AS (SELECT event_type, user_id % 5 AS run, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT event_type, round(avg(m), 6) AS mean, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(m) END, 6) AS std FROM runs GROUP BY 1
""")
def std_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation across runs of the runs' means."""
    runs = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("m"))
    return runs.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("std"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, min_by(event_type, (-n, event_type)) AS winner, max(n) AS votes, count(*) > 1 AS ambiguous FROM c GROUP BY 1
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("winner"), F.max("n").alias("votes"), (F.count("*") > 1).alias("ambiguous"))


@query("""
SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, count_if(lang = 'en') AS en, count_if(lang = 'de') AS de, count_if(lang = 'fr') AS fr, count_if(lang = 'es') AS es, count_if(n_chars < 500) AS short FROM documents GROUP BY 1
""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = [F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")]
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.countDistinct("lang").alias("langs"), *langs, F.count_if(F.col("n_chars") < 500).alias("short"))


@query("""
SELECT event_type AS attribute, count(DISTINCT user_id) AS owners, string_agg(DISTINCT CAST(strftime(ts, '%Y-%m') AS VARCHAR), ',' ORDER BY CAST(strftime(ts, '%Y-%m') AS VARCHAR)) AS sessions FROM events GROUP BY 1
""")
def attribute_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("attribute")).agg(F.countDistinct("user_id").alias("owners"), F.array_join(F.sort_array(F.collect_set(F.date_format("ts", "yyyy-MM"))), ",").alias("sessions"))


@query("""
WITH s AS (SELECT o_orderpriority AS model, o_totalprice AS runtime, o_orderstatus = 'F' AS answered FROM orders)
SELECT model, count(*) AS sessions, round(sum(runtime), 4) AS total, round(sum(runtime) / count(*), 6) AS per_session, round(CASE WHEN count_if(answered) > 0 THEN sum(runtime) FILTER (answered) / count_if(answered) ELSE 0 END, 6) AS per_answered FROM s GROUP BY 1
""")
def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages with two denominators: all sessions, and those answered."""
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.count("*").alias("sessions"), F.round(F.sum("o_totalprice"), 4).alias("total"), F.round(F.avg("o_totalprice"), 6).alias("per_session"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(done, F.col("o_totalprice"))), F.count_if(done)), F.lit(0.0)), 6).alias("per_answered"),
    )


@query("""
WITH k AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events)
SELECT k, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value * n1) / nullif(sum(n1), 0), 6) AS weighted FROM (SELECT *, CASE WHEN value > 0 THEN value ELSE 0 END AS n1 FROM k) GROUP BY k
""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.greatest("value", F.lit(0.0))
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.try_divide(F.sum(F.col("value") * w), F.sum(w)), 6).alias("weighted"))


@query("""
WITH h AS (SELECT doc_id, n_chars, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
p AS (SELECT *, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 8 AS shard FROM h)
SELECT CAST(shard AS BIGINT) AS shard, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first, max(doc_id) AS last FROM p GROUP BY 1
""")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to eight shards by a hash of their ids: no order over all rows is needed, and a new row moves no other."""
    shard = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 8
    return table(spark, sf_dir, "documents").groupBy(shard.alias("shard")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""
WITH a AS (SELECT conv_id, turn, 1 AS shard FROM conversations WHERE role <> 'assistant'), b AS (SELECT conv_id, turn, 2 AS shard FROM conversations WHERE role <> 'user'),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT conv_id, count(*) AS turns, CAST(sum(copies - 1) AS BIGINT) AS repeated, CAST(sum(CASE WHEN shard = 1 THEN 1 ELSE 0 END) AS BIGINT) AS from_first FROM (SELECT conv_id, turn, min(shard) AS shard, count(*) AS copies FROM u GROUP BY 1, 2) GROUP BY 1
""")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping shards: the first copy of a row wins, repeats are counted."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    u = c.where("role <> 'assistant'").withColumn("shard", F.lit(1)).unionByName(c.where("role <> 'user'").withColumn("shard", F.lit(2)))
    rows = u.groupBy("conv_id", "turn").agg(F.min("shard").alias("shard"), F.count("*").alias("copies"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.col("copies") - 1).alias("repeated"), F.sum(F.when(F.col("shard") == 1, 1).otherwise(0)).alias("from_first"))


@query("""
SELECT o_custkey, round(max(o_totalprice), 2) AS dearest, count(*) AS orders, mode FROM (SELECT *, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS mode FROM orders) GROUP BY o_custkey, mode
""")
def best_row_supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged candidates where the best row supplies the path."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.max("o_totalprice"), 2).alias("dearest"), F.count("*").alias("orders"), F.max_by("o_orderpriority", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("mode"))
