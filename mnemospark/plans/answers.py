"""Queries on answers, questions, identities and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.operators import answers as A
from mnemospark.operators import executors as X
from mnemospark.operators import profiles as PF
from mnemospark.operators import windows as W

from .registry import query, table
from .search import _COSINE, _CENTRES, _centres, _vectors

_STOP = "['a', 'an', 'the', 'is', 'are', 'was', 'were', 'of', 'to', 'in', 'on', 'and', 'or', 'for', 'with']"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(translate({}, '_-', '  ')), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
WITH p AS (SELECT d.doc_id, b.item_id, d.text AS answer, b.text AS reference, {_PLAIN.format("d.text")} AS said, {_PLAIN.format("b.text")} AS want FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
w AS (SELECT doc_id, item_id, len([v FOR v IN list_transform(string_split_regex(reference, '\|\||\n|;') || [reference], lambda x: {_PLAIN.format('x')}) IF v <> '' AND contains(said, v)]) > 0 AS whole, list_distinct([x FOR x IN string_split(want, ' ') IF length(x) > 1 AND NOT list_contains({_STOP}, x)]) AS a, list_distinct([x FOR x IN string_split(said, ' ') IF length(x) > 1 AND NOT list_contains({_STOP}, x)]) AS b FROM p)
SELECT doc_id, item_id, CASE WHEN whole THEN 1.0 WHEN len(a) > 0 AND 2 * len(list_intersect(a, b)) >= len(a) THEN 0.5 ELSE 0.0 END AS credit FROM w
""")
def partial_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an answer to one item: full, half or no credit."""
    d, b = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer")), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))
    met = d.join(b, F.col("doc_id") % b.count() == F.col("item_id"))
    return met.select("doc_id", "item_id", A.partial_credit(F.col("answer"), F.col("reference")).alias("credit"))


@query(rf"""
WITH p AS (SELECT d.doc_id, b.item_id, d.text AS answer, b.text AS reference, {_PLAIN.format("d.text")} AS said, {_PLAIN.format("b.text")} AS want FROM documents d CROSS JOIN benchmark b),
w AS (SELECT doc_id, item_id, len([v FOR v IN list_transform(string_split_regex(reference, '\|\||\n|;') || [reference], lambda x: {_PLAIN.format('x')}) IF v <> '' AND contains(said, v)]) > 0 AS whole, list_distinct([x FOR x IN string_split(want, ' ') IF length(x) > 1 AND NOT list_contains({_STOP}, x)]) AS a, list_distinct([x FOR x IN string_split(said, ' ') IF length(x) > 1 AND NOT list_contains({_STOP}, x)]) AS b FROM p)
SELECT doc_id, item_id, CAST(CASE WHEN whole THEN 1.0 WHEN len(a) > 0 AND 2 * len(list_intersect(a, b)) >= len(a) THEN 0.5 ELSE 0.0 END AS DOUBLE) AS credit FROM w
""")
def answer_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an answer to every item; partial_credit takes one item each."""
    return A.credits(*_answers(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer")), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))


@query()
def bleu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an answer to every item."""
    return A.bleu_pairs(*_answers(spark, sf_dir)).withColumn("bleu", F.round("bleu", 6))


@query("""
WITH c AS (SELECT user_id AS item, min(CASE event_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1)
SELECT item, stage FROM c, (SELECT unnest(['memory', 'retrieval', 'answer', 'correction', 'judging', 'scoring']) AS stage, unnest(range(6)) AS i) WHERE i >= n
""")
def stage_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages of each item a change makes stale."""
    ev = table(spark, sf_dir, "events")
    kind = ev.agg(F.min("event_type")).first()[0]
    changed = ev.where(F.col("event_type") == kind).select(F.col("user_id").alias("item"), F.element_at(F.array(*map(F.lit, A.STAGES[::-1])), (F.col("event_id") % 6 + 1).cast("int")).alias("stage"))
    return A.stale_after(changed)


@query("""
SELECT user_id, event_id, date_diff('year', b, d) - CASE WHEN (month(d), day(d)) < (month(b), day(b)) THEN 1 ELSE 0 END AS age FROM (SELECT user_id, event_id, CAST(ts AS DATE) AS d, DATE '1970-01-01' + CAST(user_id % 9000 AS INTEGER) AS b FROM events)
""")
def age_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    born, day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("user_id") % 9000).cast("int")), F.to_date("ts")
    early = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(born), F.dayofmonth(born))
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.year(day) - F.year(born) - early.cast("int")).cast("long").alias("age"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS e, CAST(o_orderdate AS DATE) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CAST(greatest(0, date_diff('day', o + 30, s)) AS BIGINT) AS least_days, CAST(greatest(0, date_diff('day', o, e)) AS BIGINT) AS most_days, CAST(greatest(0, date_diff('day', o + 30, s), date_diff('day', e, o)) AS BIGINT) AS gap_days FROM a
""")
def uncertain_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most days from an order (known to thirty days) to a shipment (known to some), and the gap between the two spans."""
    o, s = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    e = F.date_add(s, F.col("l_quantity").cast("int"))
    days = lambda *d: F.greatest(F.lit(0), *d).cast("long")
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", days(F.datediff(s, F.date_add(o, 30))).alias("least_days"), days(F.datediff(e, o)).alias("most_days"), days(F.datediff(s, F.date_add(o, 30)), F.datediff(o, e)).alias("gap_days"))


@query(f"""
WITH {_CENTRES}, s AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, probe, round({_COSINE}, 6) AS score FROM embeddings, centre)
SELECT id, label, probe AS nearest, score, CASE WHEN score >= 0.55 THEN 'route' ELSE 'new' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, probe) AS r FROM s) WHERE r = 1
""")
def topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain each node goes to: the nearest by cosine, or a new one under 0.55. Chains are few and broadcast."""
    met = _vectors(spark, sf_dir).join(F.broadcast(_centres(spark, sf_dir))).select("id", F.col("label").cast("long").alias("label"), "probe", F.round(C.cosine(F.col("pv"), F.col("v")), 6).alias("score"))
    best = met.groupBy("id", "label").agg(F.max_by(F.struct("probe", "score"), F.struct("score", -F.col("probe"))).alias("b"))
    return best.select("id", "label", F.col("b.probe").alias("nearest"), F.col("b.score").alias("score"), F.when(F.col("b.score") >= 0.55, "route").otherwise("new").alias("decision"))


@query("""
SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts, event_id
""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
WITH p AS (SELECT o_custkey AS a, o_orderkey % 300 AS b, o_orderkey FROM orders), k AS (SELECT least(a, b) AS x, greatest(a, b) AS y, min(o_orderkey) AS first, count(*) AS times FROM p WHERE a <> b GROUP BY 1, 2) SELECT * FROM k
""")
def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs once each, whichever way round."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 300).alias("b"), "o_orderkey").where("a <> b")
    return p.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("o_orderkey").alias("first"), F.count("*").alias("times"))


@query("""
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS seen, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_user FROM conversations)
SELECT conv_id, turn, printf('Q_%03d', n) AS ordinal, CAST(seen AS BIGINT) AS visible_chars, coalesce(turn - last_user <= 1, FALSE) AS cooling FROM r
""")
def visible_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each turn within its role, how much text is visible by then, and whether the user spoke just now."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("Q_%03d", n).alias("ordinal"), F.sum(F.length("text")).over(w).alias("visible_chars"), F.coalesce(F.col("turn") - last <= 1, F.lit(False)).alias("cooling"))


@query("""
WITH got AS (SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), want AS (SELECT o_custkey AS q, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT n, round(avg(hit / greatest(1, need)), 6) AS recall, round(avg(hit / n), 6) AS precision, count(*) AS questions FROM (
 SELECT k.n, w.q, count(DISTINCT w.id) AS need, count(DISTINCT CASE WHEN g.rank <= k.n THEN g.id END) AS hit FROM (SELECT unnest([1, 3, 5]) AS n) k CROSS JOIN want w LEFT JOIN got g ON g.q = w.q AND g.id = w.id GROUP BY 1, 2) GROUP BY n
""")
def trace_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence recall and precision at 1, 3 and 5 over all questions that have evidence."""
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    at = o.select(F.col("o_custkey").alias("q"), rank.alias("rank"), (F.col("o_orderpriority") == "1-URGENT").alias("want")).where("want")
    own = at.withColumn("n", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).groupBy("q", "n").agg(F.count("*").alias("need"), F.count_if(F.col("rank") <= F.col("n")).alias("hit"))
    return own.groupBy("n").agg(F.round(F.avg(F.col("hit") / F.col("need")), 6).alias("recall"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("precision"), F.count("*").alias("questions"))


@query("""
WITH m AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, d, CAST(sum(n) AS BIGINT) AS total, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM m GROUP BY 1, 2
""")
def session_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened in each session, by kind."""
    n = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"))
    own = F.transform(F.sort_array(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws("=", x["event_type"], x["n"].cast("string")))
    return n.groupBy("user_id", "d").agg(F.sum("n").alias("total"), F.array_join(own, ",").alias("histogram"))


@query("""
SELECT doc_id, round(0.5 + least(0.12, 0.03 * (doc_id % 6)) - 0.08 * (doc_id % 3) + 0.04 * 0.9 + CASE WHEN doc_id % 2 = 0 AND doc_id % 5 = 0 THEN -0.05 WHEN doc_id % 2 = 0 THEN 0.03 ELSE 0 END, 6) AS score,
 round(least(0.12, CASE WHEN lang = 'en' THEN 0.05 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 0.05 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.06 ELSE 0 END), 6) AS hints FROM documents
""")
def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    score = A.ranking_score(F.lit(0.5), i % 6 + 1, i % 3, F.lit(0.9), i % 2 == 0, i % 5 == 0)
    hints = A.soft_hints((F.col("lang") == "en", 0.05), (F.col("n_chars") > 1000, 0.05), (F.col("source") == "src0", 0.06))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"), F.round(hints, 6).alias("hints"))


@query("""
WITH p AS (SELECT s_nationkey AS type, s_suppkey AS id, s_acctbal AS x FROM supplier), d AS (SELECT a.id, b.id AS near, abs(a.x - b.x) AS gap FROM p a JOIN p b ON a.type = b.type AND a.id <> b.id)
SELECT id, near, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, near) AS r FROM d) WHERE r = 1
""")
def nearest_same_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other entity of the same type, of equally near ones the smallest: each value of a type once, with its two
    smallest ids, between its neighbours in order, so no pair within a type is made. An unknown value is far from all."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x")).where("type IS NOT NULL")

    def two(by: list[str]) -> DataFrame:
        first = own.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where("r <= 2")
        return first.groupBy(*by).agg(F.min("id").alias("a"), F.max(F.when(F.col("r") == 2, F.col("id"))).alias("b"))

    w = Window.partitionBy("type").orderBy("x")
    side = lambda f: F.when(f("a").over(w).isNotNull(), F.struct(F.abs(F.col("x") - f("x").over(w)).alias("gap"), f("a").over(w).alias("near")))
    values = two(["type", "x"])
    beside = values.where("x IS NOT NULL").select("type", "x", "a", "b", F.array_min(F.array_compact(F.array(side(F.lag), side(F.lead)))).alias("n"))
    unknown = values.where("x IS NULL").select("type", F.col("a").alias("u"))
    every = two(["type"]).select("type", F.col("a").alias("ta"), F.col("b").alias("tb"))
    at = own.join(beside, ["type", "x"], "left").join(unknown, "type", "left").join(every, "type")
    other = lambda gap, near: F.struct(gap.cast("double").alias("gap"), near.alias("near"))
    equal = other(F.lit(0.0), F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    far = other(F.lit(None), F.when(F.col("x").isNotNull(), F.col("u")).when(F.col("id") == F.col("ta"), F.col("tb")).otherwise(F.col("ta")))
    n = F.when(F.col("b").isNotNull(), equal).otherwise(F.coalesce("n", far))
    return at.select("id", n.alias("n")).where("n.near IS NOT NULL").select("id", "n.near", F.round("n.gap", 6).alias("gap"))


@query("""
WITH r AS (SELECT persona, point, session, lead(session) OVER (PARTITION BY persona ORDER BY session) AS nxt FROM (SELECT user_id AS persona, event_type AS point, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS BIGINT) AS session FROM events GROUP BY ALL))
SELECT persona, count(*) AS pairs, count_if(nxt - session BETWEEN 5 AND 15) AS short_gaps, count_if(nxt - session >= 20) AS long_gaps, coalesce(max(nxt - session), 0) AS widest FROM r WHERE nxt IS NOT NULL AND nxt > session GROUP BY 1
""")
def interval_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbouring sessions, by the variant they suit."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long")
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("persona"), F.col("event_type").alias("point"), day.alias("session")).distinct()
    gap = F.lead("session").over(Window.partitionBy("persona").orderBy("session")) - F.col("session")
    g = s.select("persona", gap.alias("gap")).where("gap > 0")
    return g.groupBy("persona").agg(F.count("*").alias("pairs"), F.count_if(F.col("gap").between(5, 15)).alias("short_gaps"), F.count_if(F.col("gap") >= 20).alias("long_gaps"), F.max("gap").alias("widest"))


@query("""
WITH d AS (SELECT doc_id, source, n_chars FROM documents), r AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM d) SELECT doc_id, source, CAST((run - 1) // 20000 AS BIGINT) AS bucket FROM r
""")
def long_context_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put one after the other into contexts of 20,000 characters, by where they end."""
    run = W.running(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), "run")
    return run.select("doc_id", "source", F.floor((F.col("run") - 1) / 20000).cast("long").alias("bucket"))


@query("""
WITH h AS (SELECT user_id AS chain, event_id, value, ts FROM events), heads AS (SELECT chain, max_by(event_id, (ts, event_id)) AS head FROM h GROUP BY 1), rel AS (SELECT event_id AS source, chain, (chain * 7 + 1) % (SELECT count(DISTINCT user_id) FROM events) AS other FROM h WHERE value > 90)
SELECT source, head AS target, CAST(round(0.8 * 0.9, 6) AS DOUBLE) AS confidence FROM rel JOIN heads ON other = heads.chain WHERE other <> rel.chain
""")
def affects_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortcuts from an event to the head of another chain that it touches, at eight tenths of the confidence."""
    ev = table(spark, sf_dir, "events")
    heads = ev.groupBy(F.col("user_id").alias("other")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("target"))
    chains = heads.agg(F.count("other").alias("chains"))  # one row
    rel = ev.where("value > 90").crossJoin(F.broadcast(chains)).select(F.col("event_id").alias("source"), F.col("user_id").alias("chain"), ((F.col("user_id") * 7 + 1) % F.col("chains")).alias("other"))
    return rel.join(heads, "other").where("other <> chain").select("source", "target", F.round(F.lit(0.8 * 0.9), 6).alias("confidence"))


@query("""
WITH u AS (SELECT event_id, user_id, event_type, value, sha256(concat_ws('|', user_id::VARCHAR, event_type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR))) AS print FROM events)
SELECT print, min(event_id) AS first, count(*) AS replays FROM u GROUP BY 1
""")
def replay_idempotence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by fingerprint: the first counts, the rest are replays."""
    rounded = F.floor("value").cast("long")
    p = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", rounded.cast("string")), 256)
    return table(spark, sf_dir, "events").groupBy(p.alias("print")).agg(F.min("event_id").alias("first"), F.count("*").alias("replays"))


@query(r"""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, ['count', 'list', 'slots', 'infer'][1 + o_orderkey % 4] AS op, o_orderkey % 5 > 0 AS complete, o_orderkey % 11 = 0 AS two, o_orderpriority AS p, o_orderstatus AS s FROM orders),
i AS (SELECT l_orderkey AS k, list({'n': l_linenumber, 'id': ' Part  ' || upper(l_returnflag) || (l_partkey % 3), 'v': 'p' || (l_partkey % 3) || l_returnflag, 'said': l_linestatus = 'O' OR l_linenumber < 5, 'on': l_discount < 0.08} ORDER BY l_linenumber, l_returnflag, l_partkey % 3, l_linestatus = 'O' OR l_linenumber < 5 DESC, l_discount < 0.08) AS items FROM lineitem GROUP BY 1),
x AS (SELECT *, len([t FOR t IN items IF t.on AND NOT t.said]) > 0 AS bad, [t FOR t IN items IF t.on] AS picked, [t.v FOR t IN items] AS vs FROM o JOIN i USING (k)),
y AS (SELECT *, [t.v FOR t, j IN picked IF list_position([q.id FOR q IN picked], t.id) = j] AS firsts, [v FOR v, j IN vs IF list_position(vs, v) = j] AS values FROM x),
z AS (SELECT *, CASE WHEN m < 2 THEN CASE WHEN bad THEN 'item without support' END WHEN m = 2 THEN CASE WHEN len([t FOR t IN items IF NOT t.said]) > 0 THEN 'slot without support' END ELSE CASE WHEN k % 3 = 2 THEN 'no candidate' WHEN NOT items[1].said THEN 'candidate without support' WHEN k % 9 = 0 THEN 'candidate contradicted' END END AS warning FROM y),
n AS (SELECT *, CASE WHEN complete AND warning IS NULL THEN CASE WHEN m < 2 THEN CASE WHEN len(firsts) > 0 AND NOT two THEN CASE m WHEN 0 THEN CAST(len(firsts) AS VARCHAR) ELSE array_to_string(firsts, ', ') END END
  WHEN m = 2 THEN CASE WHEN len([v FOR v IN values IF NOT contains(lower(p), lower(v))]) > 0 THEN array_to_string(values, '; ') END ELSE 'Likely ' || items[1].v END END AS new FROM z)
SELECT k AS id, coalesce(new, p) AS answer, CASE WHEN new IS NOT NULL THEN p END AS model_answer, warning FROM n
""")
def executed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' answers worked out from their lines: how many kinds of parts, which, or the first one; lines that aren't said support nothing."""
    n = F.col("l_linenumber")
    value = F.concat(F.lit("p"), F.col("l_partkey") % 3, F.col("l_returnflag"))
    said = (F.col("l_linestatus") == "O") | (n < 5)
    row = F.struct(n.alias("n"), F.concat(F.lit(" Part  "), F.upper("l_returnflag"), F.col("l_partkey") % 3).alias("id"), value.alias("v"), F.when(said, F.concat(F.lit("LINE "), n, F.lit(" has "), value)).otherwise("never said").alias("quote"), (F.col("l_discount") < 0.08).alias("on"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("l"), F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.lit("line   "), n, F.lit(" has "), value)))).alias("context"))
    k = F.col("o_orderkey")
    op = F.element_at(F.array(*map(F.lit, ("count", "list", "slots", "infer"))), (1 + k % 4).cast("int"))
    o = table(spark, sf_dir, "orders").select(k.alias("id"), op.alias("op"), F.col("o_orderpriority").alias("answer"), F.element_at(F.array(*map(F.lit, ("1", "1", "4", "3"))), (1 + k % 4).cast("int")).alias("category"), F.when(k % 11 == 0, "How many parts and when did they come?").otherwise("How many parts came").alias("question")).join(lines, "id")
    first = F.struct(F.get("l", F.lit(0))["v"].alias("value"), F.array(F.get("l", F.lit(0))["quote"]).alias("quotes"), F.when(F.col("id") % 9 == 0, "no").alias("contradiction"))
    work = F.struct(
        F.col("op").alias("operation"), (F.col("id") % 5 > 0).alias("complete"), F.transform("l", lambda x: F.struct(x["on"].alias("include"), x["id"].alias("id"), x["v"].alias("value"), x["quote"].alias("quote"))).alias("items"),
        F.transform("l", lambda x: F.struct(F.lit("part").alias("attribute"), x["v"].alias("value"), x["quote"].alias("quote"))).alias("slots"), F.array(first).alias("candidates"), F.when(F.col("id") % 3 == 2, 1).otherwise(0).alias("chosen"),
    )
    return X.executed(o.withColumn("work", work.cast(X.WORK)).drop("l", "op")).select("id", "answer", "model_answer", "warning")


@query("""
WITH c AS (SELECT c_custkey AS persona, c_name, c_nationkey AS n, c_mktsegment AS seg, c_custkey % 4 AS sib FROM customer),
s AS (SELECT persona, i, CASE WHEN i % 2 = 1 THEN 'Brother' END AS kind FROM c, unnest(range(1, sib + 1)) AS u(i))
SELECT persona, 'Name' AS path, c_name AS value FROM c UNION ALL SELECT persona, 'Birthplace', 'n' || n FROM c WHERE n % 3 > 0 UNION ALL SELECT persona, 'Education_Background.Major', seg FROM c
UNION ALL SELECT persona, 'Family_Information.Mother.Name', 'm' || persona FROM c WHERE n % 2 = 0 UNION ALL SELECT persona, 'Family_Information.Mother.Birth_Date', '1960-01-01' FROM c WHERE n % 2 = 0
UNION ALL SELECT persona, 'Family_Information.Sibling_' || i || '.Type', kind FROM s WHERE kind IS NOT NULL UNION ALL SELECT persona, 'Family_Information.Sibling_' || i || '.Name', 's' || i FROM s
UNION ALL SELECT persona, 'Family_Information.Has_Mother', CASE WHEN n % 2 = 0 THEN 'Yes' ELSE 'No' END FROM c UNION ALL SELECT persona, 'Family_Information.Has_Father', 'No' FROM c
UNION ALL SELECT persona, 'Family_Information.Has_Siblings', CASE WHEN sib > 0 THEN 'Yes' ELSE 'No' END FROM c UNION ALL SELECT persona, 'Family_Information.Sibling_Count', CAST(sib AS VARCHAR) FROM c
""")
def static_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each customer's nested profile can be contradicted; relatives are a map of any size."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    s = lambda x: F.lit(x).cast("string")
    person = lambda kind, name, born: F.struct(kind.alias("Type"), name.alias("Name"), born.alias("Birth_Date"), F.struct(F.lit("kept out").alias("Note")).alias("More"))
    mother = F.when(n % 2 == 0, F.array(F.struct(F.lit("Mother").alias("k"), person(s(None), F.concat(F.lit("m"), c), s("1960-01-01")).alias("v"))))
    siblings = F.transform(F.slice(F.array(*map(F.lit, range(1, 4))), F.lit(1), (c % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("Sibling_"), i.cast("string")).alias("k"), person(F.when(i % 2 == 1, "Brother"), F.concat(F.lit("s"), i.cast("string")), s(" ")).alias("v")))
    family = F.map_from_entries(F.concat(F.coalesce(mother, F.array().cast("array<struct<k:string,v:struct<Type:string,Name:string,Birth_Date:string,More:struct<Note:string>>>>")), siblings))
    school = F.struct(s(None).alias("Highest_Degree"), F.col("c_mktsegment").alias("Major"), s("").alias("University"))
    profile = F.struct(F.col("c_name").alias("Name"), s(None).alias("Gender"), F.when(n % 3 > 0, F.concat(F.lit("n"), n)).alias("Birthplace"), school.alias("Education_Background"), family.alias("Family_Information"), F.array(F.lit("not a fact")).alias("Hobbies"))
    return PF.static_facts(table(spark, sf_dir, "customer").select(c.alias("persona"), profile.alias("profile")))
