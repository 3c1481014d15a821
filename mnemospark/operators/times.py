"""Times in words: read against an anchor into intervals, found in texts, shown by precision, and how long they lie apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.columns import once
from mnemospark.functions.lazy import pd

#: Names of months and days, and numbers in words.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
VAGUE = ("a couple", "couple", "few", "several")

_AMOUNT = r"a\s+couple|couple|few|several|a|an|one|two|three|four|five|six|seven|eight|nine|ten|\d+"
_DAY = "|".join(DAYS)
_ORDINAL = "(?:st|nd|rd|th)?"

#: How times are written in a text, and how exact each form is (0 most).
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_WEEKDAY = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
_NUMBER = f"(?:{_AMOUNT})"
WRITTEN = (
    (r"\b\d{4}-\d{1,2}-\d{1,2}(?:[T ][0-2]?\d:[0-5]\d(?::[0-5]\d)?)?\b", 0),
    (rf"\b{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?\b", 0),
    (rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}(?:,?\s+\d{{4}})?\b", 0),
    (rf"\b{_WEEKDAY}\s+(?:before|after)\s+\d{{1,2}}(?:st|nd|rd|th)?\s+[A-Za-z]+,?\s+\d{{4}}\b", 1),
    (rf"\b{_MONTH}\s+\d{{4}}\b", 1),
    (r"\b(?:last|next|this|previous|following)\s+(?:year|month|week|weekend|day|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b", 1),
    (r"\b(?:yesterday|today|tomorrow)\b", 1),
    (r"\b(?:the\s+day\s+(?:before\s+yesterday|after\s+tomorrow))\b", 1),
    (r"\b(?:day\s+(?:before\s+yesterday|after\s+tomorrow))\b", 1),
    (rf"\b(?:in\s+)?(?:{_NUMBER}\s+)?(?:years?|months?|weeks?|days?)\s+(?:ago|before|after|later|from\s+now)\b", 1),
    (rf"\bin\s+(?:{_NUMBER}\s+)(?:years?|months?|weeks?|days?)\b", 1),
    (rf"\b{_WEEKDAY}\b", 2),
    (r"\b(?:19|20)\d{2}\b", 2),
)


def _looked_up(name: Column, names: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), name)


_FULL = {name: i for i, name in enumerate(MONTHS, 1)}
_ANY = _FULL | {name[:3]: i for name, i in _FULL.items()}


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is none."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", F.when(month.isNotNull(), year), two(month), two(day)).try_cast("date")


def iso_moment(text: Column) -> Column:
    """A moment from ISO 8601 alone, without zone: one with a zone is taken to UTC; anything else is null."""
    text = F.trim(text)
    plain = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$")
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})$")
    shift = F.regexp_replace(F.regexp_extract(text, r"([+-]\d{2}:?\d{2})$", 1), ":", "")
    minutes = F.when(shift == "", 0).otherwise((F.concat(F.substring(shift, 1, 1), F.lit("1"))).try_cast("int") * (F.substring(shift, 2, 2).try_cast("int") * 60 + F.substring(shift, 4, 2).try_cast("int")))
    local = F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return F.when(plain, text.try_cast("timestamp_ntz")).when(zoned, local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes))


def moment(text: Column) -> Column:
    """A moment from ISO 8601 or a written date ("8 May, 2023", "May 8 2023", "1:56 pm on 8th May, 2023", 2023/05/08)."""
    clean = F.regexp_replace(F.trim(text), r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    part = lambda pattern, i: F.regexp_extract(clean, pattern, i)
    month = lambda pattern, i: _looked_up(F.lower(part(pattern, i)), _FULL)
    clock, dmy, mdy, slash = r"(?i)^(\d{1,2}):(\d{2})\s*([ap])m on (\d{1,2}) ([a-z]+),? (\d{4})$", r"(?i)^(\d{1,2}) ([a-z]+),? (\d{4})$", r"(?i)^([a-z]+) (\d{1,2}),? (\d{4})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    hour = part(clock, 1).try_cast("int")
    at = _day(part(clock, 6), month(clock, 5), part(clock, 4)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part(clock, 3)) == "p", 12).otherwise(0)), mins=F.when(part(clock, 2).try_cast("int") < 60, part(clock, 2).try_cast("int")))
    return F.coalesce(
        iso_moment(text),
        F.when(clean.rlike(clock), at),
        _day(part(dmy, 3), month(dmy, 2), part(dmy, 1)).cast("timestamp_ntz"),
        _day(part(mdy, 3), month(mdy, 1), part(mdy, 2)).cast("timestamp_ntz"),
        _day(part(slash, 1), part(slash, 2).try_cast("int"), part(slash, 3)).cast("timestamp_ntz"),
    )


def _found(start: Column, end: Column, precision: Column | str, status: str, method: Column | str) -> Column:
    """What was read, null where the start is. Start and end are bound to a variable: they are long and read several times."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    shown = lambda t: F.when(lit(precision) == "datetime", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    told = lambda x: F.when(x["s"].isNotNull(), F.struct(shown(x["s"]).alias("starts"), shown(x["e"]).alias("ends"), lit(precision).alias("precision"), F.lit(status).alias("status"), lit(method).alias("method")))
    return F.get(F.transform(F.array(F.struct(start.alias("s"), end.alias("e"))), told), F.lit(0))


def _unread(test: Column, method: str) -> Column:
    none = F.lit(None).cast("string")
    return F.when(test, F.struct(none.alias("starts"), none.alias("ends"), F.lit("unknown").alias("precision"), F.lit("unresolved").alias("status"), F.lit(method).alias("method")))


def _month(first: Column) -> tuple[Column, Column]:
    return first.cast("timestamp_ntz"), F.last_day(first).cast("timestamp_ntz")


def absolute(said: Column) -> Column:
    """Struct of starts, ends, precision, status and method of a time that needs no anchor; null if it is none."""
    return F.coalesce(*_absolute(F.trim(said)))


def _absolute(said: Column) -> list[Column]:
    """A column for each form of such a time, null for other forms."""
    part = lambda pattern, i: F.regexp_extract(said, pattern, i)
    whole = lambda pattern, value: F.when(said.rlike(pattern), value)
    spread, clock = r"(?i)^(\d{4}-\d{1,2}-\d{1,2})\s+(?:to|through|until|-)\s+(\d{4}-\d{1,2}-\d{1,2})$", rf"(?i)^\d{{1,2}}:\d{{2}}\s*[ap]m\s+on\s+\d{{1,2}}{_ORDINAL}\s+[a-z]+,?\s+\d{{4}}$"
    first, last = iso_moment(part(spread, 1)), iso_moment(part(spread, 2))
    year_month, year = r"^(\d{4})-(\d{1,2})$", r"(?i)^(?:in\s+)?((?:19|20)\d{2})$"
    mdy, dmy, named = rf"(?i)^(?:on\s+)?([a-z]+)\s+(\d{{1,2}}){_ORDINAL},?\s+(\d{{4}})$", rf"(?i)^(?:on\s+)?(\d{{1,2}}){_ORDINAL}\s+([a-z]+),?\s+(\d{{4}})$", r"(?i)^(?:in\s+)?([a-z]+)\s+(\d{4})$"
    month = lambda pattern, i: _looked_up(F.lower(part(pattern, i)), _ANY)
    own = _month(_day(part(year_month, 1), part(year_month, 2).try_cast("int"), F.lit(1)))
    in_month = _month(_day(part(named, 2), month(named, 1), F.lit(1)))
    in_year = _day(part(year, 1), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    point = lambda t: (t, t)
    return [
        whole(spread, F.when(last >= first, _found(first, last, "range", "absolute", "iso_range"))),
        whole(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?$", _found(*point(iso_moment(said)), "datetime", "absolute", "iso_datetime")),
        whole(clock, _found(*point(moment(said)), "datetime", "absolute", "locomo_datetime")),
        whole(r"^\d{4}-\d{1,2}-\d{1,2}$", _found(*point(iso_moment(said)), "date", "absolute", "iso_date")),
        whole(year_month, _found(*own, "month", "absolute", "iso_month")),
        whole(year, _found(in_year, in_year + F.make_ym_interval(F.lit(1)) - F.make_dt_interval(F.lit(1)), "year", "absolute", "year")),
        whole(mdy, _found(*point(_day(part(mdy, 3), month(mdy, 1), part(mdy, 2)).cast("timestamp_ntz")), "date", "absolute", "named_date")),
        whole(dmy, _found(*point(_day(part(dmy, 3), month(dmy, 2), part(dmy, 1)).cast("timestamp_ntz")), "date", "absolute", "named_date_dmy")),
        whole(named, _found(*in_month, "month", "absolute", "named_month")),
    ]


def _shifted(anchor: Column, amount: Column, unit: Column, method: Column | str) -> Column:
    """The year, month, week (from Monday) or day that lies `amount` units from the anchor."""
    month = F.trunc(F.add_months(F.trunc(anchor, "month"), (amount * F.when(unit == "year", 12).otherwise(1)).cast("int")), "month")
    year = F.trunc(month, "year")
    week = F.trunc(F.date_add(anchor.cast("date"), (amount * 7).cast("int")), "week")
    day = F.date_add(anchor.cast("date"), amount.cast("int"))
    start = F.when(unit == "year", year).when(unit == "month", month).when(unit == "week", week).otherwise(day)
    end = F.when(unit == "year", F.date_sub(F.add_months(year, 12), 1)).when(unit == "month", F.last_day(month)).when(unit == "week", F.date_add(week, 6)).otherwise(day)
    precision = F.when(unit == "year", "year").when(unit == "month", "month").when(unit == "week", "range").otherwise("date")
    return _found(start.cast("timestamp_ntz"), end.cast("timestamp_ntz"), precision, "resolved_relative", method)


def _weekday(name: Column) -> Column:
    return _looked_up(name, {d: i for i, d in enumerate(DAYS)})


def _to_weekday(day: Column, target: Column, back: Column, on: Column) -> Column:
    """The weekday before, or after, or in the week of a day; never the day itself where it is before or after."""
    gap = target - F.weekday(day)
    return F.date_add(day, F.when(back & (gap >= 0), gap - 7).when(on & (gap <= 0), gap + 7).otherwise(gap).cast("int"))


def relative(said: Column, anchor: Column) -> Column:
    """As absolute, for a time that is relative to the anchor (a timestamp): "last week", "3 days ago", "next Monday" ..."""
    return F.coalesce(*_relative(said, anchor))


def _relative(said: Column, anchor: Column) -> list[Column]:
    low = F.regexp_replace(F.regexp_replace(F.lower(said), r"\s+", " "), r"^[ .,;:]+|[ .,;:]+$", "")
    part = lambda pattern, i: F.regexp_extract(low, pattern, i)
    whole = lambda pattern, value: F.when(low.rlike(pattern), value)
    two, near = r"^(?:the )?day (before yesterday|after tomorrow)$", r"^(?:the )?(last|previous|next|following|this) (year|month|week|day)$"
    weekend, ahead = r"^(?:the )?(last|previous|next|following|this) weekend$", rf"^in ({_AMOUNT}) (year|month|week|day)s? ?$"
    counted, simple = rf"\b({_AMOUNT})\s+(year|month|week|day)s?\s+(ago|before|after|later|from\s+now)\b", r"^(?:the )?(day|week|month|year) (before|after)$"
    weekday = rf"^(?:on )?(?:(last|previous|next|following|this) )?({_DAY})$"
    amount = lambda word: F.coalesce(_looked_up(word, NUMBERS), word.try_cast("int"))
    step = lambda way: F.when(way.isin("last", "previous"), -1).when(way.isin("next", "following"), 1).otherwise(0)
    saturday = F.date_add(F.trunc(anchor, "week"), (step(part(weekend, 1)) * 7 + 5).cast("int"))
    back = part(counted, 3).isin("ago", "before")
    way = part(weekday, 1)
    on_day = _to_weekday(anchor.cast("date"), _weekday(part(weekday, 2)), way.isin("last", "previous"), way.isin("next", "following")).cast("timestamp_ntz")
    return [
        whole(two, _shifted(anchor, F.when(part(two, 1) == "before yesterday", -2).otherwise(2), F.lit("day"), F.concat(F.lit("relative_day_"), F.replace(part(two, 1), F.lit(" "), F.lit("_"))))),
        whole("^(?:yesterday|today|tomorrow)$", _shifted(anchor, F.when(low == "yesterday", -1).when(low == "tomorrow", 1).otherwise(0), F.lit("day"), F.concat(F.lit("relative_"), low))),
        whole(near, _shifted(anchor, step(part(near, 1)), part(near, 2), F.concat_ws("_", F.lit("relative"), part(near, 1), part(near, 2)))),
        whole(weekend, _found(saturday.cast("timestamp_ntz"), F.date_add(saturday, 1).cast("timestamp_ntz"), "range", "resolved_relative", F.concat_ws("_", F.lit("relative"), part(weekend, 1), F.lit("weekend")))),
        whole(ahead, F.coalesce(_unread(part(ahead, 1).isin(*VAGUE), "ambiguous_quantifier"), _shifted(anchor, amount(part(ahead, 1)), part(ahead, 2), "relative_in"))),
        whole(counted, F.coalesce(_unread(F.regexp_replace(part(counted, 1), r"\s+", " ").isin(*VAGUE), "ambiguous_quantifier"), _shifted(anchor, amount(part(counted, 1)) * F.when(back, -1).otherwise(1), part(counted, 2), F.concat(F.lit("relative_"), F.regexp_replace(part(counted, 3), r"\s+", "_"))))),
        whole(simple, _shifted(anchor, F.when(part(simple, 2) == "before", -1).otherwise(1), part(simple, 1), "relative_before_after")),
        whole(weekday, F.when(way == "", _found(on_day, on_day, "date", "resolved_relative_defaulted", "relative_weekday_defaulted")).otherwise(_found(on_day, on_day, "date", "resolved_relative", "relative_weekday"))),
    ]


def beside_date(said: Column) -> Column:
    """As absolute, for a weekday before or after a written date ("the Sunday before 25 May 2023")."""
    low = F.regexp_replace(F.regexp_replace(F.lower(said), r"\s+", " "), r"^[ .,;:]+|[ .,;:]+$", "")
    form = rf"^(?:the )?({_DAY}) (before|after) (\d{{1,2}}){_ORDINAL} ([a-z]+),? (\d{{4}})$"
    part = lambda i: F.regexp_extract(low, form, i)
    at = _day(part(5), _looked_up(part(4), _ANY), part(3))
    day = _to_weekday(at, _weekday(part(1)), part(2) == "before", part(2) == "after").cast("timestamp_ntz")
    return F.when(low.rlike(form), _found(day, day, "date", "resolved_relative", "weekday_before_after_date"))


def normalized(said: Column, anchor: Column, references: Column | None = None) -> Column:
    """Struct of starts, ends, precision, status and method of a time in words; the clock of the machine is never read.

    anchor is a timestamp. references maps labels to timestamps: an expression with "before" or "after" that names one of
    them is read against it, and one that names several is ambiguous.
    """
    said = F.trim(said)
    return F.coalesce(*_ways(said, _anchor(said, anchor, references), references))


def _named(said: Column, references: Column) -> Column:
    low = F.lower(said)
    named = F.filter(F.map_entries(references), lambda r: F.contains(low, F.lower(r["key"])) & r["value"].isNotNull())
    return F.when(low.rlike(r"\b(?:before|after)\b"), named)


def _anchor(said: Column, anchor: Column, references: Column | None) -> Column:
    return anchor if references is None else F.coalesce(F.get(_named(said, references), F.lit(0))["value"], anchor)


def _ways(said: Column, anchor: Column, references: Column | None) -> list[Column]:
    """A column for each way to read a time, in order of precedence; the last one always reads something."""
    ambiguous = [] if references is None else [_unread(F.coalesce(F.size(_named(said, references)) > 1, F.lit(False)), "ambiguous_reference_anchor")]
    first = [_unread(said.isNull() | (said == ""), "missing_expression"), *_absolute(said), *ambiguous, beside_date(said), _unread(anchor.isNull(), "missing_anchor")]
    return [*first, *_relative(said, anchor), _unread(F.lit(True), "ambiguous_or_unsupported")]


def with_times(df: DataFrame, said: Column, anchor: Column, references: Column | None = None, name: str = "t") -> DataFrame:
    """df with normalized as a column that is computed once a row. Each way to read a time is a step of its own, passed
    over where an earlier one has read it: all in one expression are more code than Spark compiles."""
    at = once(once(df, "_said", F.trim(said)), "_anchor", _anchor(F.trim(said), anchor, references))
    steps = _ways(F.col("_said"), F.col("_anchor"), references)
    at = once(at, name, steps[0])
    for step in steps[1:]:
        at = once(at, name, F.coalesce(F.col(name), step))
    return at.drop("_said", "_anchor")


def shown(starts: Column, ends: Column, precision: Column) -> Column:
    """How an interval is shown: as exact as its precision; midnight of a moment is its day."""
    midnight = starts.rlike(r"T00:00:00(?:Z|[+-]\d{2}:?\d{2})?$")
    out = F.when(precision == "year", F.left(starts, F.lit(4))).when(precision == "month", F.left(starts, F.lit(7))).when(precision == "date", F.left(starts, F.lit(10)))
    out = out.when((precision == "range") & (F.coalesce(ends, F.lit("")) != ""), F.concat(F.left(starts, F.lit(10)), F.lit(" to "), F.left(ends, F.lit(10))))
    return F.when(F.coalesce(starts, F.lit("")) != "", out.when((precision == "datetime") & midnight, F.left(starts, F.lit(10))).otherwise(starts))


def precision_of(text: Column) -> Column:
    """How exact an ISO time is written: year, month, date, datetime; null for anything else."""
    text, day = F.trim(text), r"(?:19|20)\d{2}-\d{1,2}-\d{1,2}"
    forms = ((r"(?:19|20)\d{2}", "year"), (r"(?:19|20)\d{2}-\d{1,2}", "month"), (day, "date"), (day + r"[T ]\d{1,2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?", "datetime"))
    return reduce(lambda rest, form: F.when(text.rlike(f"^{form[0]}$"), form[1]).otherwise(rest), reversed(forms), F.lit(None).cast("string"))


def demoted(starts: Column, ends: Column, precision: Column, said: Column) -> Column:
    """Struct of starts, ends, precision and demoted: a moment whose words name no time of day is only a date."""
    clock = said.rlike(r"(?i)\b\d{1,2}:\d{2}\b|\b\d{1,2}\s*[ap]\.?m\b")
    day = F.date_format(iso_moment(starts), "yyyy-MM-dd")
    off = F.coalesce((precision == "datetime") & (said != "") & ~clock & day.isNotNull(), F.lit(False))
    last = F.coalesce(F.nullif(F.left(ends, F.lit(10)), F.lit("")), day)
    return F.struct(F.when(off, day).otherwise(starts).alias("starts"), F.when(off, last).otherwise(ends).alias("ends"), F.when(off, "date").otherwise(precision).alias("precision"), off.alias("demoted"))


def duration(starts: Column, ends: Column, unit: Column) -> Column:
    """"5 weeks": from one partial date (2023, 2023-05, 2023-05-08) to another in days, weeks (half up), months or years;
    null if the second is before the first, or one is less exact than the unit."""
    point = lambda c: (F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int"), F.regexp_extract(c, r"^\d{4}-(\d{2})", 1).try_cast("int"), F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")))
    (year_a, month_a, day_a), (year_b, month_b, day_b) = point(starts), point(ends)
    days = F.datediff(day_b, day_a)
    n = F.when(unit == "days", days).when(unit == "weeks", F.floor(days / 7 + 0.5)).when(unit == "months", (year_b - year_a) * 12 + month_b - month_a).when(unit == "years", year_b - year_a).cast("long")
    # weeks that round to 0 from a negative span are no duration either
    return F.when((n >= 0) & (~unit.isin("days", "weeks") | (days >= 0)), F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.regexp_replace(unit, "s$", "")).otherwise(unit)))


def expressions(text: str | None) -> list[str]:
    """The times written in a text, most exact forms first, then by place; what lies within a longer one is part of it."""
    spans: dict[tuple[int, int], int] = {}
    for span, rank in _written(text or ""):
        spans[span] = min(rank, spans.get(span, rank))
    out, reach = [], -1
    for begin, end in sorted(spans, key=lambda s: (s[0], -s[1])):  # one sweep: whatever ends no later than the reach lies within what reached it
        if end > reach:
            out.append((spans[begin, end], begin, end))
            reach = end
    return [text[b:e] for _, b, e in sorted(out)]


_COMPILED = [(re.compile(p, re.IGNORECASE), rank) for p, rank in WRITTEN]
#: The same for texts in lower case, which are read faster; no form has an escape that lower case would change.
_LOWER = [(re.compile(p.lower()), rank) for p, rank in WRITTEN]
_WORD = re.compile(r"\w+")
#: The words that each form of WRITTEN begins with, where that isn't a number; and the forms that begin with
#: a number of one, two or four digits, with another, and with digits and letters.
_UNITS = {f"{unit}{s}" for unit in ("year", "month", "week", "day") for s in ("", "s")}
_MONTH_WORDS = {*MONTHS, *(m[:3] for m in MONTHS)}
_OPENING = (
    set(), _MONTH_WORDS, set(), set(DAYS), _MONTH_WORDS, {"last", "next", "this", "previous", "following"}, {"yesterday", "today", "tomorrow"}, {"the"}, {"day"},
    {"in", "couple", "few", "several", *NUMBERS, *_UNITS}, {"in"}, set(DAYS), set(),
)
_BY_DIGITS, _BY_NUMBER, _BY_ORDINAL = {1: (2, 9), 2: (2, 9), 4: (0, 9, 12)}, (9,), (2,)
_BY_WORD = {w: tuple(i for i, some in enumerate(_OPENING) if w in some) for w in set().union(*_OPENING)}


def _written(text: str) -> Iterator[tuple[tuple[int, int], int]]:
    """The spans of all forms and their ranks, each form's as finditer gives them. Every form begins with a whole word, so
    it is tried only at words that may begin it; one that isn't ASCII may equal another in a different case, and tries all."""
    plain = text.isascii()
    text, forms = (text.lower(), _LOWER) if plain else (text, _COMPILED)
    reach = [0] * len(forms)
    for word in _WORD.finditer(text):
        w = word[0]
        if plain or w.isascii():
            some = _BY_WORD.get(w if plain else w.lower(), ())
            if not some and w[0].isdigit():
                some = _BY_DIGITS.get(len(w), _BY_NUMBER) if w.isdigit() else _BY_ORDINAL
        else:
            some = range(len(forms))
        for i in some:
            if (at := word.start()) >= reach[i] and (m := forms[i][0].match(text, at)):
                reach[i] = m.end()
                yield m.span(), forms[i][1]


def expressions_in(text: Column) -> Column:
    """expressions as a column. Spark's own patterns give no places, so this one is an Arrow UDF."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([expressions(t) for t in s])

    return run(text)
