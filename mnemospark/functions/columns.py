"""Column builders: ids, texts, vectors, times and judgements. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "␟"
WORD = r"[\p{L}\p{N}_']+"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first 24 hex digits of the parts' SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(SEPARATOR, *(p.cast("string") for p in parts)), 256), 1, 24))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a plain one may be copied into every place that reads it."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def collapsed(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")))


def answer_text(text: Column) -> Column:
    """How the scorer reads an answer: no case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, "_-", "  ")), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def compact(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.least(F.greatest(dot(a, b) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def overlap_share(a: Column, b: Column) -> Column:
    """Distinct members of a that b has, over a's."""
    a = F.array_distinct(a)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


def longer_share(a: Column, b: Column) -> Column:
    """Common distinct tokens over the longer set's."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def exact_mention(term: Column, mentions: Column) -> Column:
    """1 for a mention equal to the term, 0.8 for one that contains it, 0.6 for one within it, else 0; what lies in the
    other has two characters or more."""
    one = lambda m: F.when(m == term, 1.0).when((F.length(term) > 1) & F.contains(m, term), 0.8).when((F.length(m) > 1) & F.contains(term, m), 0.6).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(mentions, one)), F.lit(0.0))


def rank_support(rank: Column, k: Column | int) -> Column:
    """1 / log2(rank + 1) for ranks 1 to k, else 0."""
    return F.when(rank.between(1, k), 1 / F.log2(rank + 1)).otherwise(0.0)


def half_steps(x: Column, all_or_none: Column) -> Column:
    """A judge's accuracy: 1 from 0.75 on, 0.5 from 0.25 on (0 where all_or_none holds), else 0; unreadable is 0."""
    x = x.try_cast("double")
    return F.when(x >= 0.75, 1.0).when((x >= 0.25) & ~all_or_none, 0.5).otherwise(0.0)


def begins(value: Column, precision: Column) -> Column:
    """First moment of a time of the given precision (year, month, date, datetime)."""
    at = value.try_cast("timestamp_ntz")
    return F.when(precision == "year", F.date_trunc("year", at)).when(precision == "month", F.date_trunc("month", at)).when(precision == "date", F.date_trunc("day", at)).otherwise(at).cast("timestamp_ntz")


def ends(value: Column, precision: Column) -> Column:
    """Last second of a time of the given precision."""
    first, second = begins(value, precision), F.expr("INTERVAL 1 SECOND")
    end = F.when(precision == "year", first + F.expr("INTERVAL 1 YEAR") - second).when(precision == "month", first + F.expr("INTERVAL 1 MONTH") - second).when(precision == "date", first + F.expr("INTERVAL 1 DAY") - second)
    return end.otherwise(first)


def proximity(gap_seconds: Column) -> Column:
    return 1 / (1 + gap_seconds / 86400.0 / 30.0)


def interval_gap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Seconds between two intervals, 0 where they touch, 1e12 where a start is unknown."""
    apart = F.greatest(F.lit(0.0), (start_b - end_a).cast("double"), (start_a - end_b).cast("double"))
    return F.when(start_a.isNull() | start_b.isNull(), 1e12).otherwise(apart)


def hash_unit(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
