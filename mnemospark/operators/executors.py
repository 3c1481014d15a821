"""Answers worked out from what a model has listed: counts, lists, slots and inferences whose quotes stand in the context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.columns import collapsed

from .judging import grounded

#: The work of an answer, as executed() reads it.
WORK = (
    "struct<operation: string, complete: boolean, items: array<struct<include: boolean, id: string, value: string, quote: string>>, "
    "slots: array<struct<attribute: string, value: string, quote: string>>, candidates: array<struct<value: string, quotes: array<string>, contradiction: string>>, chosen: int>"
)
#: Which operation a category's answers may be worked out by, and questions that ask for something else too.
CATEGORY = {"count": "1", "list": "1", "infer": "3", "slots": "4"}
COMPOUND = (
    r"(?i)(?:\band\b|\balso\b|[;,?])\s*(?:for\s+)?(?:what|which|where|when|why|who|how|list|describe|name|explain|identify|did|does|do|is|was|were|are|has|have|will|would)\b",
    r"(?i)\b(?:and|also)\s+(?:what|where|when|why|who|which|how)\b",
)


def compound(question: Column) -> Column:
    return reduce(lambda a, b: a | b, (question.rlike(p) for p in COMPOUND))


def _said(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def _distinct(pairs: Column) -> Column:
    """The first of the structs (key, value) of each key, in order."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)


def executed(answers: DataFrame) -> DataFrame:
    """answers (answer, category, question, context, work as WORK; other columns pass) with answer as worked out, model_answer
    (what it was, where it changed) and warning (why work that was there wasn't used).

    count and list: how many different things, or which, are included, each with an id, a value and a quote from the context;
    the first of equal ids counts. A question that also asks something else keeps its answer, and so does work that
    isn't complete. slots: the different values, if the answer lacks one. infer: the chosen candidate if the answer lacks it, all its
    quotes are in the context and nothing contradicts it. Work that is of no use to the category is left alone. Empty or
    null lists, texts and quotes support nothing.
    """
    w, context = F.col("work"), F.col("context")
    op = F.when(w["operation"].isin(*CATEGORY), w["operation"])
    fits = reduce(lambda a, b: a | b, ((op == o) & (F.col("category") == c) for o, c in CATEGORY.items()))
    full = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    bad_item = lambda x: x["include"].isNull() | (x["include"] & ~(_said(x["id"]) & _said(x["value"]) & grounded(x["quote"], context)))
    picked = _distinct(F.transform(F.filter(w["items"], lambda x: x["include"]), lambda x: F.struct(collapsed(x["id"]).alias("key"), F.trim(x["value"]).alias("value"))))
    bad_slot = lambda x: ~(_said(x["value"]) & grounded(x["quote"], context))
    values = F.array_distinct(F.transform(w["slots"], lambda x: x["value"]))
    lacks = lambda v: ~F.contains(collapsed(F.coalesce(F.col("answer"), F.lit(""))), collapsed(v))
    one = F.get(w["candidates"], w["chosen"])
    warning = (
        F.when(~fits | op.isNull(), F.when(w.isNull(), "no work"))
        .when(op.isin("count", "list"), F.when(~full(w["items"]), "no items").when(F.exists(w["items"], bad_item), "item without support"))
        .when(op == "slots", F.when(~full(w["slots"]), "no slots").when(F.exists(w["slots"], bad_slot), "slot without support"))
        .otherwise(
            F.when(w["chosen"].isNull() | (w["chosen"] < 0) | one.isNull(), "no candidate").when(~_said(one["value"]), "candidate without a value")
            .when(~full(one["quotes"]) | F.exists(one["quotes"], lambda q: ~grounded(q, context)), "candidate without support").when(_said(one["contradiction"]), "candidate contradicted")
        )
    )
    told = F.transform(picked, lambda p: p["value"])
    new = (
        F.when(op.isin("count", "list"), F.when(full(picked) & ~compound(F.coalesce("question", F.lit(""))), F.when(op == "count", F.size(picked).cast("string")).otherwise(F.array_join(told, ", "))))
        .when(op == "slots", F.when(F.exists(values, lacks), F.array_join(values, "; ")))
        .otherwise(F.when(lacks(one["value"]), F.concat(F.lit("Likely "), one["value"])))
    )
    at = answers.withColumn("_warning", warning).withColumn("_new", F.when(fits & F.coalesce(w["complete"], F.lit(False)) & F.col("_warning").isNull(), new))
    return at.select(*(c for c in answers.columns if c not in ("answer", "model_answer", "warning")), F.coalesce("_new", "answer").alias("answer"), F.when(F.col("_new").isNotNull(), F.col("answer")).alias("model_answer"), F.col("_warning").alias("warning"))
