"""What the plans must look like: few columns read, filters at the scan, no products of tables, groups cut before shuffles."""

import re

import pytest

from mnemospark.operators import personas as P
from mnemospark.plans import registry

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["before_k", "overlap_join", "entity_division", "temporal_next", "stale_checkpoints", "token_f1", "entity_jaccard", "expand_scored", "nearest_same_type", "bm25_or", "lexical_relevance", "cross_scope_candidates", "expand_by_intent", "merged_candidates", "rescued_topk", "normalised_relations", "event_relations", "cross_scope_relations", "repaired_evidence", "exact_mentions"])
def test_no_products(spark, data, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, data)))


def test_columns_are_pruned(spark, data):
    p = plan(QUERIES["stale_checkpoints"](spark, data))
    assert "o_totalprice" not in re.search(r"ReadSchema: \S+", p)[0] and "o_custkey" in p


def test_filters_reach_the_scan(spark, data):
    p = plan(QUERIES["prediction_pairs"](spark, data))
    assert "EqualTo(l_linestatus,F)" in p


def test_ranks_cut_groups_early(spark, data):
    assert "WindowGroupLimit" in plan(QUERIES["quota_topk"](spark, data)) or "WindowGroupLimit" in plan(QUERIES["entity_match_topk"](spark, data))


def test_the_index_holds_only_what_is_asked_for(spark, data):
    from pyspark.sql import functions as F

    from mnemospark.operators import search as S

    nodes = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    indexed = S.index(nodes, spark.createDataFrame([(1, "the"), (1, "of")], "probe long, term string"))
    assert {r.term for r in indexed.select("term").distinct().collect()} <= {"the", "of", None}
    assert indexed.count() <= 3 * nodes.count() and indexed.groupBy("id").agg(F.sum("tf").alias("n"), F.max("dl").alias("dl")).where("n <> dl").count() == 0


def test_long_intervals_do_not_fan_out(spark):
    from pyspark.sql import functions as F

    from mnemospark.operators import temporal as T

    one = spark.sql("SELECT 1 AS k, TIMESTAMP '0100-01-01' AS ls, TIMESTAMP '9999-01-01' AS le")
    other = spark.range(200).select(F.lit(1).alias("k"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("rs")).withColumn("re", F.col("rs"))
    joined = T.overlapping(one, other, ["k"])
    assert joined.count() == 200 and "CartesianProduct" not in plan(joined)


def test_lookups_read_nodes_a_few_times(spark, data):
    assert plan(QUERIES["virtual_lookup"](spark, data)).count("FileScan") < 15


@pytest.mark.parametrize("name", ["time_relative_full", "time_absolute_full", "time_against_references"])
def test_times_in_words_are_little_code(spark, data, name):
    """Spark compiles methods of 64 KB at most; all forms in one expression were megabytes."""
    stages = QUERIES[name](spark, data)._jdf.queryExecution().debug().codegenToSeq()
    assert max(len(stages.apply(k)._2()) for k in range(stages.size())) < 65_536


def test_equally_near_suppliers_go_by_id(spark, tmp_path):
    import duckdb

    rows = [(i, f"S{i}", n, x) for i, (n, x) in enumerate([(1, 5.0), (1, 5.0), (1, 5.0), (1, 7.0), (1, 3.0), (1, 7.0), (2, 1.0), (2, None), (2, None), (3, 4.0), (4, None), (4, None), (None, 5.0), (5, 2.0), (5, 4.0), (5, 6.0)])]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["nearest_same_type"]).fetchall()
    assert sorted(map(tuple, QUERIES["nearest_same_type"](spark, str(tmp_path)).collect())) == sorted(want)


def test_lives_broadcast_no_sessions(spark, data):
    found = plan(QUERIES["full_lives"](spark, data))
    assert "Join" not in found and "BroadcastExchange" not in found


def test_calendar_keeps_what_is_known_of_people(spark):
    seeds = spark.createDataFrame([(1, "a"), (2, "b")], "persona long, name string")
    own = P.calendar(spark, seeds)
    assert sorted(own.collect()) == sorted(P.calendar(spark, seeds.select("persona")).join(seeds, "persona").select(*own.columns).collect())
