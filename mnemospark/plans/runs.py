"""Queries on records of runs: orders are sessions and questions, lines attributes, facts and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.shared import sized
from mnemospark.operators import records as RC

from .registry import query, table

_KINDS = ("initial_reveal", "update", "chitchat", "future_plan", "other")
_ATTRIBUTES = (*RC.FIRST_TOLD, "Hobby")


@query(f"""
WITH l AS (SELECT l_orderkey AS session, list({list(_ATTRIBUTES)}[1 + l_partkey % 8] ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS session, {list(_KINDS)}[1 + o_orderkey % 5] AS kind, (o_orderkey % 97) / 97.0 AS u, coalesce(a, []) AS a FROM orders LEFT JOIN l ON session = o_orderkey),
m AS (SELECT *, list_filter(list_transform(a, lambda x: MAP {RC.FIRST_TOLD}[x]), lambda x: x IS NOT NULL) AS t, list_filter(list_transform(a, lambda x: MAP {RC.CHANGED}[x]), lambda x: x IS NOT NULL) AS c FROM s)
SELECT session, CASE kind WHEN 'initial_reveal' THEN CASE WHEN len(t) > 0 THEN array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') ELSE 'Initial_Life_Update' END WHEN 'update' THEN CASE WHEN len(c) > 0 THEN array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') ELSE 'General_Life_Update' END
  WHEN 'chitchat' THEN {list(RC.SMALL_TALK)}[1 + CAST(floor(u * 10) AS INTEGER) % 10] WHEN 'future_plan' THEN 'Future_Planning_Conversation' ELSE 'General_Conversation' END AS types FROM m
""")
def session_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session is about, by what its lines tell or change."""
    pick = lambda some, at: F.element_at(F.array(*map(F.lit, some)), (at + 1).cast("int"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", pick(_ATTRIBUTES, F.col("l_partkey") % 8).alias("a"))
    told = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["a"]).alias("attributes"))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), pick(_KINDS, F.col("o_orderkey") % 5).alias("kind"), ((F.col("o_orderkey") % 97) / 97.0).alias("draw")).join(told, "session", "left")
    return s.select("session", F.array_join(RC.event_types(F.col("kind"), F.col("attributes"), F.col("draw")), ",").alias("types"))


@query("""
WITH q AS (SELECT l_orderkey AS session, l_linenumber AS place, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'X' || l_partkey END AS id, CASE WHEN l_suppkey % 7 = 0 THEN ' ' ELSE ' Where is part ' || l_partkey || '? ' END AS question, l_returnflag AS answer, CASE l_linestatus WHEN 'O' THEN 'static_conflict' ELSE 'odd' END AS kind FROM lineitem)
SELECT session, CASE WHEN id = '' THEN 'Q_' || lpad(CAST(place AS VARCHAR), 3, '0') ELSE id END AS question_id, CASE WHEN l_partkey % 5 = 0 THEN 'In which place does it lie?' ELSE trim(question) END AS question, answer, CASE kind WHEN 'odd' THEN 'dynamic_conflict' ELSE kind END AS conflict_type, 'recover_truth' AS ability, 'medium' AS difficulty, l_partkey % 5 = 0 AS rewritten
FROM q WHERE trim(question) <> ''
""")
def clean_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that hold, every fifth part's in other words."""
    line = table(spark, sf_dir, "lineitem")
    p = F.col("l_partkey")
    q = line.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("session"), F.col("l_linenumber").cast("int").alias("place"), F.when(p % 3 == 0, " ").otherwise(F.concat(F.lit("X"), p)).alias("question_id"),
        F.when(F.col("l_suppkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" Where is part "), p, F.lit("? "))).alias("question"), F.col("l_returnflag").alias("answer"), F.when(F.col("l_linestatus") == "O", "static_conflict").otherwise("odd").alias("conflict_type"),
        F.lit(None).cast("string").alias("ability"), F.lit("?").alias("difficulty"),
    )
    clean = RC.sanitised(q)
    new = F.when(F.col("session.l_partkey") % 5 == 0, "In which place does it lie?").otherwise(F.col("question"))
    done = RC.rewritten(clean.select("session", "question_id", "question", "answer"), clean.select("session", "question_id", new.alias("text")))
    return clean.drop("question", "answer").join(done, ["session", "question_id"]).select(F.col("session.l_orderkey").alias("session"), "question_id", "question", "answer", "conflict_type", "ability", "difficulty", "rewritten")


@query("""
SELECT o_custkey AS persona, count(*) AS questions, round(avg(a), 6) AS accuracy, count(DISTINCT o_orderkey) AS sessions FROM (SELECT o_custkey, o_orderkey, CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.5 END AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1
""")
def persona_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored questions nested by persona and session, and flattened again."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    scored = line.select(F.col("o_custkey").alias("persona"), F.col("l_orderkey").alias("session"), F.concat(F.lit("q"), "l_linenumber").alias("question_id"), F.when(F.col("l_discount") < 0.05, 1.0).otherwise(0.5).alias("accuracy"))
    flat = RC.judge_rows(RC.persona_records(scored).select("persona", "sessions"))
    return flat.groupBy("persona").agg(F.count("*").alias("questions"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.countDistinct("session").alias("sessions"))


@query("""
WITH x AS (SELECT o_custkey AS example, o_orderkey AS qa FROM orders), p AS (SELECT * FROM x WHERE qa % 50 > 0 UNION ALL SELECT * FROM x WHERE qa % 70 = 1), t AS (SELECT example, qa + CASE WHEN qa % 90 = 2 THEN 1000000 ELSE 0 END AS qa, qa % 40 AS retrieved FROM x),
r AS (SELECT 'predictions missing' AS problem FROM x WHERE (example, qa) NOT IN (SELECT (example, qa) FROM p) UNION ALL SELECT 'predictions repeated' FROM p GROUP BY example, qa HAVING count(*) > 1 UNION ALL SELECT 'traces missing' FROM x WHERE (example, qa) NOT IN (SELECT (example, qa) FROM t)
  UNION ALL SELECT 'traces not asked for' FROM t WHERE (example, qa) NOT IN (SELECT (example, qa) FROM x) UNION ALL SELECT 'too much retrieved' FROM t WHERE retrieved > 32)
SELECT problem, count(*) AS n FROM r GROUP BY 1
""")
def run_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a run whose predictions and traces are not quite those asked for."""
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("example"), F.col("o_orderkey").alias("qa"))
    qa = F.col("qa")
    return RC.acceptance(x, x.where(qa % 50 > 0).unionByName(x.where(qa % 70 == 1)), x.select("example", (qa + F.when(qa % 90 == 2, 1_000_000).otherwise(0)).alias("qa"), (qa % 40).alias("retrieved")))


@query("""
SELECT item_id AS target, CASE item_id % 3 WHEN 0 THEN 'new' ELSE 'relaxed' END AS how, CASE item_id % 3 WHEN 0 THEN 3 ELSE 1 END AS must, CASE item_id % 3 WHEN 0 THEN 0 ELSE 2 END AS should FROM benchmark WHERE item_id % 3 < 2
""")
def fresh_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes that were tried are relaxed, those that were tried relaxed too are gone."""
    none, s = F.lit(None).cast("string"), F.expr("CAST(array() AS array<string>)")
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target"), F.lower("text").alias("query"), F.array(F.lit("B"), F.lit("a "), F.lit("c")).alias("must"), s.alias("should"), s.alias("entities"), none.alias("starts"), none.alias("ends"), F.lit(True).alias("hard"))
    prints = lambda must: RC.fingerprint(F.concat(F.lit("  "), "query", F.lit("\n")), must, F.col("entities"), F.col("starts"), F.col("ends"))
    tried = p.where("target % 3 > 0").select("target", prints(F.array(F.lit("A"), F.lit("b"), F.lit("C"))).alias("print")).unionByName(p.where("target % 3 = 2").select("target", prints(F.array(F.lit("b"))).alias("print")))
    return RC.fresh_probes(p, tried).select("target", "how", F.size("must").alias("must"), F.size("should").alias("should"))


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS probe, l_suppkey AS id, 'ship_' || lower(l_returnflag) AS key, l_linestatus AS value, l_returnflag = 'A' AS cited FROM lineitem), s AS (SELECT *, (CASE WHEN key = 'ship_r' THEN 2 ELSE 1 END + CASE WHEN value = 'O' THEN 1 ELSE 0 END) / 3 AS likeness FROM f)
SELECT probe, id, key, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe, id ORDER BY cited DESC, likeness DESC, key, value) AS rank FROM s) WHERE rank <= 2
""")
def slimmed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier's facts in an order the two that bear most on what is asked: to ship what is returned (r) and open (o)."""
    line = table(spark, sf_dir, "lineitem")
    # one deal by order serves the distinct facts, their questions and their ranks
    f = sized(line.select(F.col("l_orderkey").alias("probe"), F.col("l_suppkey").alias("id"), F.concat(F.lit("ship_"), F.lower("l_returnflag")).alias("key"), F.col("l_linestatus").alias("value"), (F.col("l_returnflag") == "A").alias("cited")), line.count(), "probe", most=250_000).distinct()
    return RC.slimmed(f, f.select("probe").distinct().withColumn("text", F.lit("Ship r, o!")), 2)


@query("""
WITH l AS (SELECT l_returnflag AS stage, CAST(l_quantity AS DOUBLE) AS seconds, l_partkey AS tokens, CAST(l_tax AS DOUBLE) AS cost, l_linestatus = 'O' AS ok FROM lineitem)
SELECT stage, count(*) AS calls, CAST(count_if(NOT ok) AS BIGINT) AS failed, sum(seconds) AS seconds, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM l GROUP BY ROLLUP (stage)
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_quantity").cast("double").alias("seconds"), F.col("l_partkey").alias("tokens"), F.col("l_tax").cast("double").alias("cost"), (F.col("l_linestatus") == "O").alias("ok"))
    return RC.run_summary(log).withColumn("cost", F.round("cost", 6))


@query("""
WITH m AS (SELECT p_partkey AS id, p_size * 2 AS score FROM part WHERE p_size <= 20), a AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS supplier FROM lineitem) SELECT id, supplier, coalesce(score, p_size * 3) AS score FROM a JOIN part ON p_partkey = id LEFT JOIN m USING (id)
""")
def memoised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that are remembered for some parts and computed, once each, for the others."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("supplier")).distinct().join(part.select("id"), "id")
    memo = part.where("p_size <= 20").select("id", (F.col("p_size") * 2).alias("score"))
    found, _ = RC.memoised(asked, ["id"], memo, lambda todo: todo.join(part, "id").select("id", (F.col("p_size") * 3).alias("score")))
    return found.select("id", "supplier", "score")
