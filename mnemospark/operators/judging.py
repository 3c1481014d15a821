"""How answers are judged by rules: normal forms, exact match and F1, signals of change and conflict, concepts, grounded quotes, corrected times."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.columns import answer_text, collapsed, rank_support

from .evaluation import KINDS
from .times import duration, shown

#: Words that tell of a change, pairs that tell of its order, and words that tell of a conflict.
CHANGED = ("changed", "change", "updated", "update", "switched")
ORDERED = (("from", "to"), ("previously", "now"), ("used to", "now"), ("before", "now"))
CONFLICTING = ("inconsisten", "conflict", "contradict", "cannot confirm", "uncertain", "mismatch")
#: Numbers as words and digits, and how a time is told relative to another.
DIGITS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
RELATIVE = (
    r"\b(?:last|next|previous|following|this)\s+(?:year|month|week|day|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\b(?:a|an|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:years?|months?|weeks?|days?)\s+(?:ago|before|after|later)\b",
    r"\b(?:a|an|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:years?|months?|weeks?|days?)\s+from\s+now\b",
    r"\bin\s+(?:a|an|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:years?|months?|weeks?|days?)\b",
    r"\b(?:the\s+)?day\s+(?:before\s+yesterday|after\s+tomorrow)\b",
    r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\s+(?:before|after)\b",
    r"\b(?:yesterday|today|tomorrow)\b",
)
NO_TIME = "The retrieved evidence does not provide enough unambiguous absolute-time information to answer reliably."


def alnum(text: Column) -> Column:
    """The text's runs of a-z, 0-9 and apostrophes, in lower case, with single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1)), " ")


def plain(text: Column) -> Column:
    """Lower case without ASCII punctuation and the words a, an, the; single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def against_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """id, exact_match and token_f1 of each answer (id, text): the best over its references (id, reference); 0 without any.

    Tokens are those of the plain text and count as often as they come. An answer meets all of its references in one row and
    is compared with them there, so no token is a row. Where both are empty F1 is 1, where one is it is 0.
    """
    said = answers.select("id", plain(F.coalesce("text", F.lit(""))).alias("a"))
    refs = references.where("trim(coalesce(reference, '')) <> ''").select("id", plain(F.col("reference")).alias("b")).groupBy("id").agg(F.collect_set("b").alias("bs"))
    words = lambda x: Counter(w for w in x.split(" ") if w)

    def f1(a: Counter, b: Counter) -> float:
        n_a, n_b = a.total(), b.total()
        return 2.0 * sum(min(n, a[w]) for w, n in b.items() if w in a) / (n_a + n_b) if n_a and n_b else float(n_a == n_b)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, best = [], []
            for a, bs in zip(batch.column("a").to_pylist(), batch.column("bs").to_pylist(), strict=True):
                own = words(a)
                exact.append(float(a in bs))
                best.append(max(f1(own, words(b)) for b in bs))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(exact, pa.float64()), pa.array(best, pa.float64())], names=["id", "exact_match", "token_f1"])

    scored = said.join(refs, "id").select("id", "a", "bs").mapInArrow(compared, f"id {answers.schema['id'].dataType.simpleString()}, exact_match double, token_f1 double")
    best = scored.groupBy("id").agg(F.max("exact_match").alias("exact_match"), F.max("token_f1").alias("token_f1"))
    return said.select("id").join(best, "id", "left").na.fill(0.0, ["exact_match", "token_f1"])


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.array_max(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def tells_update_order(answer: Column) -> Column:
    """Whether an answer says that something changed, and from what to what."""
    said = answer_text(F.coalesce(answer, F.lit("")))
    order = F.lit(False)
    for a, b in ORDERED:
        order = order | (F.contains(said, F.lit(a)) & F.contains(said, F.lit(b)))
    return _any_of(said, CHANGED) & order


def tells_conflict(answer: Column) -> Column:
    return _any_of(answer_text(F.coalesce(answer, F.lit(""))), CONFLICTING)


def by_rule(conflict_type: Column, credit: Column, answer: Column) -> Column:
    """Struct of accuracy and handling by rules: what a judge would say of an answer with this credit (0, 0.5, 1).

    Dynamic conflicts are handled if the answer is half right and tells the order of updates, static ones if it tells of
    the conflict; conditional answers are right or wrong, and their handling is null.
    """
    accuracy = F.when(conflict_type == KINDS[2], (credit >= 0.5).cast("double")).when(conflict_type.isin(*KINDS), credit)
    handling = F.when(conflict_type == KINDS[0], ((credit >= 0.5) & tells_update_order(answer)).cast("int")).when(conflict_type == KINDS[1], tells_conflict(answer).cast("int"))
    return F.struct(accuracy.alias("accuracy"), handling.alias("handling"))


def white_box(judged: DataFrame, ks: list[int]) -> DataFrame:
    """For each row of judged (conflict_type, support_rank) and each k: hit, rank score and the rank where it is within k, else 0."""
    rank, k = F.coalesce("support_rank", F.lit(0)), F.col("k")
    inside = rank.between(1, k)
    return judged.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).select("*", inside.cast("double").alias("hit"), rank_support(rank, k).alias("rank_score"), F.when(inside, rank).otherwise(0).alias("rank_in_k"))


def white_box_summary(judged: DataFrame, ks: list[int]) -> DataFrame:
    """Questions, mean hit and mean rank score of each k and kind; 0 for kinds without questions, unknown kinds are left out."""
    kinds = judged.sparkSession.createDataFrame([(c, k) for c in KINDS for k in ks], "conflict_type string, k int")
    found = white_box(judged, ks).groupBy("conflict_type", "k").agg(F.count("*").alias("questions"), F.avg("hit").alias("hit"), F.avg("rank_score").alias("rank_score"))
    return kinds.join(found, ["conflict_type", "k"], "left").na.fill(0, ["questions"]).na.fill(0.0, ["hit", "rank_score"])


def short_windows(memories: Column, k: int) -> Column:
    """An aggregate: questions whose stored memories (array) are fewer than the window that they are judged in."""
    return F.count_if(F.size(F.coalesce(memories, F.array())) < k)


def positions(memories: Column, k: int) -> Column:
    """Array of (rank, memory) of the first k memories, ranks from 1."""
    return F.transform(F.slice(memories, 1, k), lambda m, i: F.struct((i + 1).alias("rank"), F.coalesce(m, F.lit("")).alias("memory")))


def concept_recall(concepts: Column, text: Column) -> Column:
    """Share of the concepts (array) that a text has, both as runs of letters and digits; 0 without concepts."""
    said = alnum(F.coalesce(text, F.lit("")))
    return F.when(F.size(concepts) > 0, F.size(F.filter(concepts, lambda c: F.contains(said, alnum(c)))) / F.size(concepts)).otherwise(0.0)


def concept_precision(concepts: Column, units: Column) -> Column:
    """Share of the units (array of texts) that have any of the concepts; 0 without units."""
    named = F.filter(F.transform(concepts, alnum), lambda c: c != "")
    hits = F.filter(units, lambda u: F.exists(named, lambda c: F.contains(alnum(u), c)))
    return F.when(F.size(units) > 0, F.size(hits) / F.size(units)).otherwise(0.0)


def proactive(rows: DataFrame) -> DataFrame:
    """rows (concepts, units, answer, judged_recall, judged_precision) with recall, precision and judge: a judge's values where there are any, else by words."""
    text = F.concat_ws("\n", F.col("units"), F.array(F.coalesce("answer", F.lit(""))))
    judge = F.when(F.col("judged_recall").isNotNull() & F.col("judged_precision").isNotNull(), "llm").when(F.coalesce("judged_recall", "judged_precision").isNull(), "lexical_fallback").otherwise("mixed")
    return rows.withColumn("recall", F.coalesce("judged_recall", concept_recall(F.col("concepts"), text))).withColumn("precision", F.coalesce("judged_precision", concept_precision(F.col("concepts"), F.col("units")))).withColumn("judge", judge)


def grounded(quote: Column, context: Column) -> Column:
    """Whether a quote stands in the context, but for case and white space; an empty one doesn't."""
    return F.coalesce((F.trim(quote) != "") & F.contains(collapsed(context), collapsed(quote)), F.lit(False))


def number_pattern(said: Column) -> Column:
    """A pattern for a phrase in which a number may also be written the other way: "two days" finds "2 days"."""
    other = DIGITS | {d: w for w, d in DIGITS.items()}
    token = lambda t: F.coalesce(F.concat(F.lit("(?:"), F.lower(t), F.lit("|"), F.try_element_at(F.create_map(*(F.lit(x) for kv in other.items() for x in kv)), F.lower(t)), F.lit(")")), F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    return F.array_join(F.transform(F.regexp_extract_all(said, F.lit(r"(\w+|\W+)"), F.lit(1)), token), "")


def tells_relative_time(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(RELATIVE))


def time_mappings(memories: DataFrame) -> DataFrame:
    """probe, said, display and ambiguous: what each time in words stands for in a probe's memories (probe, said, starts,
    ends, precision, status, method), the display that most of them have (ties: the smaller). Unsure readings don't count."""
    sure = (F.trim(F.coalesce("said", F.lit(""))) != "") & (F.coalesce("starts", F.lit("")) != "") & (F.col("status") != "unresolved") & ~F.coalesce("method", F.lit("")).rlike("defaulted|approximate")
    at = memories.where(sure).select("probe", F.trim("said").alias("said"), shown(F.col("starts"), F.col("ends"), F.col("precision")).alias("display")).where("display IS NOT NULL")
    n = at.groupBy("probe", "said", "display").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("probe", "said").orderBy(F.desc("n"), "display"))
    return n.withColumn("place", best).withColumn("kinds", F.count("*").over(Window.partitionBy("probe", "said"))).where("place = 1").select("probe", "said", "display", (F.col("kinds") > 1).alias("ambiguous"))


def corrected(answers: DataFrame, mappings: DataFrame) -> DataFrame:
    """answers (probe, answer) with corrected, relative and residual: relative times are replaced by what they stand for.

    An answer without relative times stays. Where some are left although there were mappings, it becomes NO_TIME, as no
    model rewrites it here; without mappings it stays as it is, marked as residual. Longer expressions are replaced first.
    """
    by = mappings.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct(F.length("said").alias("n"), "said", "display")), asc=False).alias("m"))
    at = answers.join(by, "probe", "left")
    replaced = F.aggregate("m", F.col("answer"), lambda text, x: F.regexp_replace(text, F.concat(F.lit("(?i)"), number_pattern(x["said"])), x["display"]))
    at = at.withColumn("relative", F.coalesce(tells_relative_time(F.col("answer")), F.lit(False))).withColumn("now", F.when(F.col("m").isNotNull(), replaced).otherwise(F.col("answer")))
    left = F.col("relative") & tells_relative_time(F.col("now"))
    return at.select("probe", "answer", F.when(~F.col("relative"), F.col("answer")).when(left & F.col("m").isNotNull(), NO_TIME).otherwise(F.col("now")).alias("corrected"), "relative", left.alias("residual"))


def computed_duration(starts: Column, ends: Column, unit: Column) -> Column:
    """A duration between two points, each a partial date or a range "a to b": "about 3 weeks to 5 weeks" where it isn't
    sure, "about 2 months" where one is less exact; null where ranges overlap or run backwards."""
    bound = lambda c, i: F.trim(F.coalesce(F.get(F.split(c, " to "), F.lit(i)), F.get(F.split(c, " to "), F.lit(0))))
    a, b, c, d = bound(starts, 0), bound(starts, 1), bound(ends, 0), bound(ends, 1)
    low, high, ranged = duration(b, c, unit), duration(a, d, unit), F.contains(starts, F.lit(" to ")) | F.contains(ends, F.lit(" to "))
    spread = F.when((a <= b) & (c <= d) & (c >= b), F.when(low == high, low).otherwise(F.concat(F.lit("about "), low, F.lit(" to "), high)))
    single = F.when((F.length(starts) != F.length(ends)) | (ends >= starts), duration(starts, ends, unit))
    return F.when(ranged, spread).when(F.length(starts) != F.length(ends), F.concat(F.lit("about "), single)).otherwise(single)
