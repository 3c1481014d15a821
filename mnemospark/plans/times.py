"""Queries on times in words: expressions of many forms are written from events' moments and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import times as T

from .registry import query, table

#: What is said about an event's day, and for the SQL: start, end, precision, status and method in terms of the day a.
_WEEK = "CAST(date_trunc('week', a) AS DATE)"
_MONTH = "CAST(date_trunc('month', a) AS DATE)"
_YEAR = "CAST(date_trunc('year', a) AS DATE)"
_SAID = (
    ("today", "a", "a", "date", "relative_today"),
    ("yesterday", "a - 1", "a - 1", "date", "relative_yesterday"),
    ("The day before yesterday", "a - 2", "a - 2", "date", "relative_day_before_yesterday"),
    ("day after tomorrow", "a + 2", "a + 2", "date", "relative_day_after_tomorrow"),
    ("last week", f"{_WEEK} - 7", f"{_WEEK} - 1", "range", "relative_last_week"),
    ("next month", f"CAST({_MONTH} + INTERVAL 1 MONTH AS DATE)", f"CAST({_MONTH} + INTERVAL 2 MONTH AS DATE) - 1", "month", "relative_next_month"),
    ("previous year", f"CAST({_YEAR} - INTERVAL 1 YEAR AS DATE)", f"{_YEAR} - 1", "year", "relative_previous_year"),
    ("this day", "a", "a", "date", "relative_this_day"),
    ("last weekend", f"{_WEEK} - 2", f"{_WEEK} - 1", "range", "relative_last_weekend"),
    ("next weekend", f"{_WEEK} + 12", f"{_WEEK} + 13", "range", "relative_next_weekend"),
    ("in 3 days", "a + 3", "a + 3", "date", "relative_in"),
    ("two weeks ago", f"{_WEEK} - 14", f"{_WEEK} - 8", "range", "relative_ago"),
    ("3 days from now", "a + 3", "a + 3", "date", "relative_from_now"),
    ("five months later", f"CAST({_MONTH} + INTERVAL 5 MONTH AS DATE)", f"CAST({_MONTH} + INTERVAL 6 MONTH AS DATE) - 1", "month", "relative_later"),
    ("a year before", f"CAST({_YEAR} - INTERVAL 1 YEAR AS DATE)", f"{_YEAR} - 1", "year", "relative_before"),
    ("the week after", f"{_WEEK} + 7", f"{_WEEK} + 13", "range", "relative_before_after"),
    ("last Monday", "a - CASE WHEN CAST(isodow(a) AS INTEGER) = 1 THEN 7 ELSE CAST(isodow(a) AS INTEGER) - 1 END", "a - CASE WHEN CAST(isodow(a) AS INTEGER) = 1 THEN 7 ELSE CAST(isodow(a) AS INTEGER) - 1 END", "date", "relative_weekday"),
    ("next Sunday", "a + CASE WHEN CAST(isodow(a) AS INTEGER) = 7 THEN 7 ELSE 7 - CAST(isodow(a) AS INTEGER) END", "a + CASE WHEN CAST(isodow(a) AS INTEGER) = 7 THEN 7 ELSE 7 - CAST(isodow(a) AS INTEGER) END", "date", "relative_weekday"),
    ("on Friday", f"{_WEEK} + 4", f"{_WEEK} + 4", "date", "relative_weekday_defaulted"),
    ("the Sunday before 25th May 2023", "DATE '2023-05-21'", "DATE '2023-05-21'", "date", "weekday_before_after_date"),
    ("a couple weeks ago", "NULL", "NULL", "unknown", "ambiguous_quantifier"),
    ("a few days ago", "NULL", "NULL", "unknown", "ambiguous_quantifier"),
    ("one fine day", "NULL", "NULL", "unknown", "ambiguous_or_unsupported"),
    ("", "NULL", "NULL", "unknown", "missing_expression"),
)


def _cases(i: int, quoted: bool = False) -> str:
    return "CASE k " + " ".join(f"WHEN {n} THEN " + (f"'{x[i]}'" if quoted else f"CAST({x[i]} AS DATE)") for n, x in enumerate(_SAID)) + " END"


@query(f"""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS a, event_id % {len(_SAID)} AS k FROM events)
SELECT event_id, {_cases(0, True)} AS said, CAST({_cases(1)} AS VARCHAR) AS starts, CAST({_cases(2)} AS VARCHAR) AS ends, {_cases(3, True)} AS precision,
  CASE WHEN {_cases(3, True)} = 'unknown' THEN 'unresolved' WHEN {_cases(4, True)} = 'relative_weekday_defaulted' THEN 'resolved_relative_defaulted' ELSE 'resolved_relative' END AS status, {_cases(4, True)} AS method FROM e
""")
def time_relative_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relative form, read against each event's moment."""
    said = F.element_at(F.array(*(F.lit(x[0]) for x in _SAID)), (F.col("event_id") % len(_SAID) + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", said.alias("said"), "ts")
    return T.with_times(df, F.col("said"), F.col("ts")).select("event_id", "said", "t.*")


_FORMS = (
    ("concat(strftime(ts, '%Y-%m-%d'), ' to ', strftime(ts + INTERVAL 9 DAY, '%Y-%m-%d'))", "strftime(ts, '%Y-%m-%d')", "strftime(ts + INTERVAL 9 DAY, '%Y-%m-%d')", "range", "iso_range"),
    ("strftime(ts, '%Y-%m-%dT%H:%M:%S')", "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "datetime", "iso_datetime"),
    ("strftime(ts, '%Y-%m-%d %H:%M+02:00')", "strftime(date_trunc('minute', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S')", "strftime(date_trunc('minute', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S')", "datetime", "iso_datetime"),
    ("concat(strftime(ts, '%-I:%M'), lower(strftime(ts, ' %p')), ' on ', strftime(ts, '%-d %B, %Y'))", "strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S')", "strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S')", "datetime", "locomo_datetime"),
    ("strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m-%d')", "date", "iso_date"),
    ("strftime(ts, '%Y-%-m')", "strftime(date_trunc('month', ts), '%Y-%m-%d')", "strftime(last_day(ts), '%Y-%m-%d')", "month", "iso_month"),
    ("strftime(ts, 'in %Y')", "strftime(ts, '%Y-01-01')", "strftime(ts, '%Y-12-31')", "year", "year"),
    ("strftime(ts, 'on %b %-dth, %Y')", "strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m-%d')", "date", "named_date"),
    ("strftime(ts, '%-d %B %Y')", "strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m-%d')", "date", "named_date_dmy"),
    ("strftime(ts, '%B %Y')", "strftime(date_trunc('month', ts), '%Y-%m-%d')", "strftime(last_day(ts), '%Y-%m-%d')", "month", "named_month"),
)
_case = lambda i, q="": "CASE event_id % 10 " + " ".join(f"WHEN {n} THEN {q}{x[i]}{q}" for n, x in enumerate(_FORMS)) + " END"


@query(f"SELECT event_id, {_case(0)} AS said, {_case(1)} AS starts, {_case(2)} AS ends, {_case(3, chr(39))} AS precision, 'absolute' AS status, {_case(4, chr(39))} AS method FROM events")
def time_absolute_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every absolute form, written from each event's moment and read back."""
    ts = lambda form: F.date_format("ts", form)
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 9 DAY"), "yyyy-MM-dd")
    forms = (
        F.concat(ts("yyyy-MM-dd"), F.lit(" to "), later), ts("yyyy-MM-dd'T'HH:mm:ss"), F.concat(ts("yyyy-MM-dd HH:mm"), F.lit("+02:00")), F.concat(ts("h:mm "), F.lower(ts("a")), F.lit(" on "), ts("d MMMM, yyyy")),
        ts("yyyy-MM-dd"), ts("yyyy-M"), F.concat(F.lit("in "), ts("yyyy")), F.concat(F.lit("on "), ts("MMM d"), F.lit("th, "), ts("yyyy")), ts("d MMMM yyyy"), ts("MMMM yyyy"),
    )
    df = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 10 + 1).cast("int")).alias("said"))
    return T.with_times(df, F.col("said"), F.lit(None).cast("timestamp")).select("event_id", "said", "t.*")


@query("""
WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS a, event_id % 4 AS k FROM events)
SELECT event_id, CAST(CASE k WHEN 0 THEN a - 2 WHEN 1 THEN DATE '2020-01-04' WHEN 3 THEN a + 1 END AS VARCHAR) AS starts, CASE k WHEN 2 THEN 'ambiguous_reference_anchor' WHEN 0 THEN 'relative_before' WHEN 1 THEN 'relative_after' ELSE 'relative_in' END AS method FROM e
""")
def time_against_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that name what they are relative to: the named time goes before the anchor, two of them are ambiguous."""
    said = F.element_at(F.array(*map(F.lit, ("2 days before the event", "three days after the New Year", "a day before the event and the New Year", "in 1 day"))), (F.col("event_id") % 4 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", said.alias("said"), F.col("ts").cast("timestamp").alias("ts"))
    known = F.create_map(F.lit("The Event"), F.col("ts"), F.lit("new year"), F.expr("TIMESTAMP '2020-01-01 12:00:00'"))
    return T.with_times(df, F.col("said"), F.col("ts"), known).select("event_id", "t.starts", "t.method")


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s, strftime(CAST(ts AS DATE), '%Y-%m-%dT%H:%M:%S') AS m, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS later FROM events)
SELECT event_id, CASE k WHEN 0 THEN left(s, 4) WHEN 1 THEN left(s, 7) WHEN 2 THEN left(s, 10) WHEN 3 THEN left(s, 10) || ' to ' || later WHEN 4 THEN left(m, 10) ELSE CASE WHEN right(s, 8) = '00:00:00' THEN left(s, 10) ELSE s END END AS shown,
  CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'date' ELSE 'datetime' END AS inferred, k IN (3, 4) AS demoted FROM e
""")
def display_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How intervals are shown, how exact an ISO time is written, and which moments are only dates in their words."""
    s, m = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.to_date("ts"), "yyyy-MM-dd'T'00:00:00")
    k = (F.col("event_id") % 6 + 1).cast("int")
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), k)
    df = table(spark, sf_dir, "events").select("event_id", pick(s, s, s, s, m, s).alias("s"), F.date_format(F.col("ts") + F.expr("INTERVAL 3 DAY"), "yyyy-MM-dd").alias("e"), pick("year", "month", "date", "range", "datetime", "datetime").alias("p"), pick("", "", "", "the other day", "last May", "at 9:30 pm").alias("said"), pick(F.left(s, F.lit(4)), F.left(s, F.lit(7)), F.left(s, F.lit(10)), s, m, s).alias("iso"))
    inferred = T.precision_of(F.col("iso"))
    return df.select("event_id", T.shown(F.col("s"), F.col("e"), F.col("p")).alias("shown"), inferred.alias("inferred"), T.demoted(F.col("iso"), F.col("e"), inferred, F.col("said"))["demoted"].alias("demoted"))


@query(r"""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, l_linenumber % 4 AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT l_orderkey, l_linenumber, k, CASE k WHEN 0 THEN b - a WHEN 1 THEN CAST(floor((b - a) / 7.0 + 0.5) AS BIGINT) WHEN 2 THEN (year(b) - year(a)) * 12 + month(b) - month(a) ELSE year(b) - year(a) END AS n, b < a AND k < 2 AS negative FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN n >= 0 AND NOT negative THEN n || ' ' || CASE k WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'month' ELSE 'year' END || CASE WHEN n = 1 THEN '' ELSE 's' END END AS label FROM n
""")
def partial_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations between dates that are only as exact as their unit needs."""
    k = (F.col("l_linenumber") % 4 + 1).cast("int")
    cut = lambda c: F.element_at(F.array(F.date_format(c, "yyyy-MM-dd"), F.date_format(c, "yyyy-MM-dd"), F.date_format(c, "yyyy-MM"), F.date_format(c, "yyyy")), k)
    unit = F.element_at(F.array(*map(F.lit, ("days", "weeks", "months", "years"))), k)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, "l_orderkey")
    return df.select("l_orderkey", "l_linenumber", T.duration(cut("o_orderdate"), cut("l_shipdate"), unit).alias("label"))


@query(r"""
WITH e AS (SELECT event_id, ts FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%d') || ' | ' || strftime(ts, '%B %-d, %Y') || ' | few days ago | the day before yesterday | in 3 weeks | Friday | ' || year(ts) AS found FROM e
""")
def time_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times written in sentences about each event: exact dates first, then relative ones, bare weekdays and years last."""
    said = F.concat(F.lit("We met a few days ago, or the day before yesterday; not on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" (that is "), F.date_format("ts", "MMMM d, yyyy"), F.lit("). See you in 3 weeks on some Friday of "), F.date_format("ts", "yyyy"), F.lit("!"))
    # of equal rank the first in the text goes first: the sentence has them in another order than the answer lists them
    df = table(spark, sf_dir, "events").select("event_id", T.expressions_in(said).alias("x"))
    return df.select("event_id", F.array_join("x", " | ").alias("found"))
