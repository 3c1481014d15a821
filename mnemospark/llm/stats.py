"""Document statistics as Spark expressions; the rules and the classifier read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

#: Ratios that describe a text; no label, language, source or id is among them.
FEATURES = (
    "symbol_ratio", "upper_ratio", "exclaim_ratio", "digit_ratio", "punct_ratio", "dup_line_ratio",
    "repeat_ratio", "word_length", "line_words", "distinct_ratio", "log_words",
)

#: The counts that the ratios come from.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits", "n_punct", "n_distinct")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row.

    A plain column may be copied into every place that reads it, also below a filter or inside a lambda, which would
    compute it for each element. What a generator makes stays where it is.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def _times(text: Column, kind: str) -> Column:
    """How many characters of a kind a text has: by how much it gets shorter without them."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))).cast("long")


def _repeated(by: str) -> Column:
    """Places of the windows that occur twice or more, ascending; `by` names the array of (window, place), sorted.

    Equal windows are neighbours there. The array is a column of its own: inside a lambda an expression would be
    computed anew for each element.
    """
    same = lambda x, k: F.get(F.col(by), k)["g"] == x["g"]
    at = F.transform(F.col(by), lambda x, k: F.when(F.when(k > 0, same(x, k - 1)).otherwise(False) | F.coalesce(same(x, k + 1), F.lit(False)), x["i"]))
    return F.sort_array(F.filter(at, lambda i: i.isNotNull()))


def _covered(places: Column) -> Column:
    """Words that windows of three at these places cover, each word once."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
        lambda a: a["n"],
    ).cast("long")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `_s`: the counts of every whole text and the FEATURES. A null text counts as empty.

    docs has no columns named _t, _w, _l, _h, _g or _s (`carried` sees to that).
    Windows are compared by hash first: without two equal hashes there are no equal windows, so only texts with
    some are looked at word by word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # what is counted by kind is neither a-z nor white space; without those, texts are short
    df = once(docs, "_t", F.regexp_replace(t, f"[a-z{SPACE}]+", ""))
    df = once(once(df, "_w", words_of(t)), "_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    three = lambda i: [F.element_at("_w", i + k) for k in (1, 2, 3)]
    windows = lambda f: F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), f))
    df = once(df, "_h", windows(lambda i: F.xxhash64(*three(i))))
    df = once(df, "_g", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(windows(lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("g"), i.alias("i"))))))
    repeats = F.when(F.col("_g").isNotNull(), _covered(_repeated("_g"))).otherwise(0)
    df = once(
        df,
        "_s",
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            _times(F.col("_t"), r"[#*$%&|<>]").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            repeats.cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            _times(F.col("_t"), r"\p{Lu}").alias("n_upper"),
            _times(F.col("_t"), "[!]").alias("n_exclaim"),
            _times(F.col("_t"), "[0-9]").alias("n_digits"),
            _times(F.col("_t"), r"[.,;:?]").alias("n_punct"),
            F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        ),
    ).drop("_t", "_w", "_l", "_h", "_g")
    s, one = F.col("_s"), lambda c: F.greatest(c, F.lit(1)).cast("double")
    chars, words, lines = one(s["word_chars"]), one(s["n_words"]), one(s["n_lines"])
    ratios = (
        s["n_symbols"] / chars, s["n_upper"] / chars, s["n_exclaim"] / chars, s["n_digits"] / chars, s["n_punct"] / chars, s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words, s["word_chars"] / words, s["n_words"] / lines, s["n_distinct"] / words, F.log1p(s["n_words"].cast("double")),
    )
    return once(df, "_s", F.struct(*(s[c].alias(c) for c in COUNTS), *(r.alias(n) for r, n in zip(ratios, FEATURES, strict=True))))


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most `most` documents that have a label, with `_y` 0 or 1; rows of the held-out fold are left out.

    The rows with the smallest hashes of their ids are taken, so the bound holds at every size. Repeated labels of a
    document are averaged; null ids and null labels don't count. The ids are broadcast: `most` bounds them.
    """
    from .common import held_out

    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.join(F.broadcast(picked), "doc_id")
