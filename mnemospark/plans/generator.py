"""Queries that generate benchmark people: customers are people, their orders what happens to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.shared import dealt
from mnemospark.operators import generator as G
from mnemospark.operators import personas as P

from .registry import query, table

_UNIT = "CAST(('0x' || substr(sha256(concat_ws('|', {})), 1, 13)) AS BIGINT) / 4503599627370496.0"
_TYPES, _GOALS = ("ENFJ", "istp", "INTJ", "esfp"), ("Career success", "a happy Family", "fitness and travel", "make friends", "none")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda some, n: F.element_at(F.array(*map(F.lit, some)), (k % n + 1).cast("int"))
    tags = F.when(k % 3 == 0, F.array(F.lit("Outgoing"))).when(k % 3 == 1, F.array(F.lit("calm"), F.lit("Stress-prone"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return table(spark, sf_dir, "customer").select(k.alias("persona"), G.drivers(pick(_TYPES, 4), tags, pick(_GOALS, 5)).alias("drive"), (1970 + k % 35).cast("int").alias("born"))


@query("""
WITH p AS (SELECT c_custkey AS persona, lower(['ENFJ', 'istp', 'INTJ', 'esfp'][1 + c_custkey % 4]) AS m, lower(['Career success', 'a happy Family', 'fitness and travel', 'make friends', 'none'][1 + c_custkey % 5]) AS g, ['outgoing', 'calm stress-prone', ''][1 + c_custkey % 3] AS t FROM customer)
SELECT persona, round(1.0 * CASE WHEN g LIKE '%fitness%' THEN 1.8 ELSE 1 END * CASE WHEN t LIKE '%stress%' THEN 1.1 ELSE 1 END, 6)::DOUBLE AS health, round(1.0 * CASE WHEN g LIKE '%friend%' THEN 1.6 ELSE 1 END * CASE WHEN m[1] = 'e' OR t LIKE '%outgoing%' THEN 1.2 ELSE 1 END, 6)::DOUBLE AS social,
  round(1.0 * CASE WHEN g LIKE '%career%' THEN 1.2 ELSE 1 END * CASE WHEN m[4] = 'j' THEN 1.1 ELSE 1 END, 6)::DOUBLE AS work, round(1.3 * CASE WHEN g LIKE '%travel%' THEN 1.6 ELSE 1 END, 6)::DOUBLE AS residence, round(1.6 * CASE WHEN g LIKE '%family%' THEN 2.0 ELSE 1 END, 6)::DOUBLE AS marital,
  round(1.8 * CASE WHEN g LIKE '%family%' THEN 1.8 ELSE 1 END, 6)::DOUBLE AS children, round(1.3 * CASE WHEN g LIKE '%career%' THEN 1.6 ELSE 1 END * CASE WHEN m[4] = 'j' THEN 1.1 ELSE 1 END, 6)::DOUBLE AS career FROM p
""")
def driver_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How readily each person's attributes change."""
    names = {"health": "Health_Status", "social": "Social_Status", "work": "Work_Status", "residence": "Residence", "marital": "Marital_Status", "children": "Children_Status", "career": "Career_Status"}
    return _people(spark, sf_dir).select("persona", *(F.round(f"drive.{a}", 6).alias(n) for n, a in names.items()))


@query(f"""
WITH p AS (SELECT c_custkey AS persona, 3 + CAST(floor({_UNIT.format("c_custkey, 'reveals'")} * 4) AS INTEGER) AS n FROM customer),
d AS (SELECT persona, day, row_number() OVER (PARTITION BY persona ORDER BY {_UNIT.format("persona, 'day', day")}) AS r, n FROM p, (SELECT unnest(range(1, 32)) AS day)),
e AS (SELECT persona, make_date(2022, 1, CAST(day AS INTEGER)) AS date, row_number() OVER (PARTITION BY persona ORDER BY day) - 1 AS place FROM d WHERE r <= n),
a AS (SELECT persona, n, attribute, row_number() OVER (PARTITION BY persona ORDER BY {_UNIT.format("persona, 'attribute', attribute")}) - 1 AS r FROM p, (SELECT unnest({list(G.REVEALED)}) AS attribute)),
g AS (SELECT persona, attribute, CASE WHEN r < n THEN r ELSE CAST(floor({_UNIT.format("persona, 'group', attribute")} * n) AS BIGINT) END AS place FROM a)
SELECT persona, CAST(place AS INTEGER) AS place, attribute, date FROM g JOIN e USING (persona, place)
""")
def reveal_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of January 2022 on which people tell their first state."""
    return G.reveals(_people(spark, sf_dir)).select("persona", F.col("place").cast("int").alias("place"), "attribute", "date")


@query()
def full_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of seven attributes over 47 months of every person's life."""
    people = dealt(_people(spark, sf_dir).where("persona IS NOT NULL"), "persona")
    return G.lives(P.calendar(spark, people))


@query(f"""
WITH g AS (SELECT o_custkey AS persona, o_orderkey AS conflict, 2 + o_orderkey % 3 AS rules, count(*) OVER (PARTITION BY o_custkey) * 3 - 2 AS last FROM orders),
a AS (SELECT *, CAST(floor({_UNIT.format("persona, conflict, 'A'")} * (least(9, last) + 1)) AS BIGINT) AS a FROM g), b AS (SELECT *, CASE WHEN a + 5 <= last THEN a + 5 ELSE a + 1 END AS lb FROM a),
b2 AS (SELECT *, CASE WHEN lb <= last THEN lb + CAST(floor({_UNIT.format("persona, conflict, 'B'")} * (last - lb + 1)) AS BIGINT) END AS b FROM b), c AS (SELECT *, CASE WHEN b + 5 <= last THEN b + 5 ELSE b + 1 END AS lc FROM b2),
c2 AS (SELECT *, CASE WHEN rules > 2 AND lc <= last THEN lc + CAST(floor({_UNIT.format("persona, conflict, 'C'")} * (last - lc + 1)) AS BIGINT) END AS c FROM c), d AS (SELECT *, CASE WHEN c + 5 <= last THEN c + 5 ELSE c + 1 END AS ld FROM c2),
d2 AS (SELECT *, CASE WHEN rules > 3 AND ld <= last THEN ld + CAST(floor({_UNIT.format("persona, conflict, 'D'")} * (last - ld + 1)) AS BIGINT) END AS d FROM d)
SELECT persona, conflict, role, CAST(session AS INTEGER) AS session FROM (SELECT persona, conflict, unnest(['Point_A', 'Point_B', 'Point_C', 'Point_D']) AS role, unnest([a, b, c, d]) AS session FROM d2) WHERE session IS NOT NULL
""")
def conditional_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.conditional_points(_conditional_groups(spark, sf_dir))


def _conditional_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = dealt(table(spark, sf_dir, "orders"), "o_custkey")
    n = (F.count("*").over(Window.partitionBy("o_custkey")) * 3).cast("int")
    return o.select(F.col("o_custkey").alias("persona"), F.col("o_orderkey").alias("conflict"), (2 + F.col("o_orderkey") % 3).cast("int").alias("rules"), n.alias("sessions"))


@query()
def conditional_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractors between the points of conditional conflicts, in small talk where there is some."""
    points = G.conditional_points(_conditional_groups(spark, sf_dir))
    talk = points.select("persona").distinct().select("persona", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(4))).alias("session"))
    return G.between(points, talk)


@query("""
WITH c AS (SELECT user_id AS persona, event_id AS session, 'Profile.' || event_type || '_Status' AS field, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before, CAST(floor(value) AS BIGINT) AS after FROM events),
q AS (SELECT *, replace(lower(split_part(field, '.', 2)), '_', ' ') AS name FROM c WHERE before IS NOT NULL)
SELECT persona, session, 'Q_001' AS question_id, 'Has the user''s ' || name || ' changed recently?' AS question, 'Yes.' AS answer, 'dynamic_conflict' AS conflict_type, 'easy' AS difficulty FROM q
UNION ALL SELECT persona, session, 'Q_002', 'How has the user''s ' || name || ' changed?', 'The user''s ' || name || ' changed from ' || before || ' to ' || after || '.', 'dynamic_conflict', 'medium' FROM q
UNION ALL SELECT persona, session, 'Q_001', 'What is the user''s ' || replace(lower(event_type), '_', ' ') || ' status?', coalesce('There is conflicting information about the user''s ' || name || '. The correct value is ' || first || ', while another statement says ' || after || '.', 'The information is inconsistent for ' || name || '. Another statement says ' || after || '. The correct value cannot be confirmed from the available context.'), 'static_conflict', 'hard'
  FROM (SELECT persona, session, replace(replace(field, 'Profile.', ''), '_Status', '') AS event_type, replace(lower(split_part(field, '.', 2)), '_', ' ') AS name, before AS first, after FROM c)
UNION ALL SELECT persona, session, 'Q_001', 'For the user''s music, under what condition is "item ' || coalesce(i, item) || '" preferred or selected?', 'For the user''s music, item ' || coalesce(i, item) || ' is associated with the condition when ' || coalesce(i, item) || '.', 'conditional_conflict', 'hard'
  FROM (SELECT *, lag(item) OVER (PARTITION BY persona, conflict ORDER BY role, session) AS i FROM (SELECT user_id AS persona, event_id AS session, event_type AS conflict, event_id AS item, 'Point_' || chr(65 + least(25, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS INTEGER))) AS role FROM events)) WHERE role <> 'Point_A'
""")
def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all three kinds about what events changed, contradicted and made conditional."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    value = F.floor("value").cast("long").cast("string")
    changes = e.select(F.col("user_id").alias("persona"), F.col("event_id").alias("session"), F.col("event_type").alias("conflict"), F.concat(F.lit("Profile."), F.col("event_type"), F.lit("_Status")).alias("field"), F.lag(value).over(order).alias("before"), value.alias("after"), F.row_number().over(order).alias("n"))
    dynamic = G.dynamic_questions(changes.where("before IS NOT NULL"))
    static = G.static_questions(changes.select("persona", "session", "conflict", "field", F.col("after").alias("value"), F.col("before").alias("first")))
    role = F.concat(F.lit("Point_"), F.char(64 + F.least(F.col("n"), F.lit(26))))
    points = changes.select("persona", "session", "conflict", role.alias("role"), F.lit("music").alias("kind"), F.concat(F.lit("item "), F.col("session")).alias("item"), F.concat(F.lit("when "), F.col("session")).alias("condition"))
    return dynamic.unionByName(static).unionByName(G.conditional_questions(points))


@query()
def long_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that fill up each user's sessions to a length, put among them as new sessions."""
    words = F.size(F.split("text", " "))
    items = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.sum(words).alias("tokens"))
    e = table(spark, sf_dir, "events")
    sessions = e.select(F.col("user_id").alias("persona"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("session"))
    needs = sessions.groupBy("persona").agg((200 + F.count("*") % 7 * 100).alias("tokens"))
    added = G.new_sessions(G.supplements(items, needs), 150)
    return G.renumbered(sessions, added)


@query(f"SELECT seed FROM (SELECT DISTINCT p_partkey AS seed FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)) ORDER BY {_UNIT.format(chr(115) + 'eed, ' + chr(39) + 'sample' + chr(39))}, seed LIMIT 25")
def sampled_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five seeds that haven't been used."""
    return G.sampled(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed")), table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("seed")), 25)


@query("""
WITH s AS (SELECT o_custkey AS persona, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS session, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS work, CASE WHEN o_orderkey % 5 = 0 THEN 'city' || (o_orderkey % 4) END AS home FROM orders),
a AS (SELECT *, coalesce(last_value(work IGNORE NULLS) OVER w, 'Calm') AS wa, coalesce(last_value(home IGNORE NULLS) OVER w, 'Darwin') AS ha FROM s WINDOW w AS (PARTITION BY persona ORDER BY session)),
b AS (SELECT *, coalesce(lag(wa) OVER w, 'Calm') AS wb, coalesce(lag(ha) OVER w, 'Darwin') AS hb FROM a WINDOW w AS (PARTITION BY persona ORDER BY session))
SELECT persona, session, date, CASE WHEN wa <> wb OR ha <> hb THEN 'update' ELSE 'chitchat' END AS kind, wb AS work_before, wa AS work, ha AS home, concat_ws(',', CASE WHEN wa <> wb THEN 'Work_Status' END, CASE WHEN ha <> hb THEN 'Residence' END) AS updated FROM b
UNION ALL SELECT persona, max(session) + 1, DATE '2026-01-15', 'future_plan', arg_max(wa, session), arg_max(wa, session), arg_max(ha, session), '' FROM b GROUP BY persona
""")
def life_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a session in its customer's life, some change work or home; each life ends with plans."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("session", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).withColumnRenamed("o_custkey", "persona")
    both = F.array(F.struct(F.lit("Work_Status").alias("field"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("after")), F.struct(F.lit("Residence").alias("field"), F.when(k % 5 == 0, F.concat(F.lit("city"), k % 4)).alias("after")))
    changes = o.select("persona", "session", F.inline(both)).where("after IS NOT NULL")
    out = G.timeline(o.select("persona", "session", F.col("o_orderdate").alias("date")), changes, {"Work_Status": "Calm", "Residence": "Darwin"})
    return out.select("persona", F.col("session").cast("long").alias("session"), "date", "kind", F.col("before")["Work_Status"].alias("work_before"), F.col("after")["Work_Status"].alias("work"), F.col("after")["Residence"].alias("home"), F.array_join("updated", ",").alias("updated"))


def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are conflicts about their customer, whose sessions are 47 months and one of plans; every second month is chitchat."""
    o = table(spark, sf_dir, "orders")
    conflicts = o.select(F.col("o_custkey").alias("persona"), F.col("o_orderkey").alias("conflict"), (F.col("o_orderkey") % 2 == 0).alias("distractor"))
    sessions = conflicts.select("persona").distinct().select("persona", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("session"))
    return G.static_points(conflicts, sessions.withColumn("kind", F.when(F.col("session") % 2 == 0, "chitchat").otherwise("update")))


@query()
def static_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every conflict is told first, again, and what distracts from it."""
    return _static(spark, sf_dir)


@query("""
SELECT o_custkey AS persona, count(*) AS points_a, count(*) AS points_b, CAST(0 AS BIGINT) AS too_near, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS last_used, CAST(0 AS BIGINT) AS twice FROM orders GROUP BY 1
""")
def static_point_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each persona's points: Point_B too near where its rung promises a gap, distractors outside, the last session used, or a session taken twice where the rung promises that it is free."""
    p = _static(spark, sf_dir)
    at = p.groupBy("persona", "conflict").pivot("role", ["Point_A", "Point_B", "Distractor"]).agg(F.first("session").alias("s"), F.first("rung").alias("r"))
    a, b, d = (F.col(f"{x}_s") for x in ("Point_A", "Point_B", "Distractor"))
    faults = at.groupBy("persona").agg(
        F.count(a).alias("points_a"), F.count(b).alias("points_b"), F.count_if((F.col("Point_B_r") < 2) & (b - a < G.STATIC_GAP)).alias("too_near"), F.count_if((d <= a) | (d >= b) | (b <= a)).alias("outside"),
        F.count_if(F.greatest(a, b) >= 47).alias("last_used"),
    )
    # a free place may hold a Point_A that comes later, as those take turns whatever is there
    free = p.where("role = 'Point_B' AND rung < 3 OR role = 'Distractor' AND rung = 0").groupBy("persona", "session").agg(F.count("*").alias("n")).groupBy("persona").agg(F.count_if(F.col("n") > 1).alias("twice"))
    return faults.join(free, "persona", "left").na.fill(0, ["twice"])
