"""Answers worked out from listed work, case by case; facts of nested profiles."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemospark.operators import executors as X
from mnemospark.operators import profiles as PF

CONTEXT = "Ann bought Two  Apples.\nBob likes tea and jazz."
ITEM = [(True, " apple ", "apples", "two apples"), (True, "APPLE", "more apples", "TWO apples"), (True, "tea", " tea", "likes tea"), (False, None, None, None)]
SLOT = [("drink", "tea", "likes tea"), ("music", "jazz", "and jazz"), ("music", "jazz", "jazz")]
GUESS = [("Berlin", ["likes tea"], None), ("Rome", ["never said"], None), ("Oslo", ["jazz"], "but"), ("Bern", [], "")]


def work(operation, complete=True, items=None, slots=None, candidates=None, chosen=None):
    return (operation, complete, items, slots, candidates, chosen)


CASES = {
    "count": (("3", "1", "How many?", work("count", items=ITEM)), ("2", "3", None)),
    "list": (("x", "1", "Which?", work("list", items=ITEM)), ("apples, tea", "x", None)),
    "count in another category": (("3", "2", "How many?", work("count", items=ITEM)), ("3", None, None)),
    "incomplete": (("3", "1", "How many?", work("count", False, items=ITEM)), ("3", None, None)),
    "compound": (("3", "1", "How many apples, and when?", work("count", items=ITEM)), ("3", None, None)),
    "no items": (("0", "1", "How many?", work("count", items=[])), ("0", None, "no items")),
    "only excluded": (("0", "1", "How many?", work("count", items=ITEM[3:])), ("0", None, None)),
    "item without a quote": (("1", "1", "How many?", work("count", items=[(True, "a", "b", "pears")])), ("1", None, "item without support")),
    "item not decided": (("1", "1", "How many?", work("count", items=[(None, "a", "b", "tea")])), ("1", None, "item without support")),
    "slots": (("tea", "4", "What?", work("slots", slots=SLOT)), ("tea; jazz", "tea", None)),
    "slots told already": (("Jazz with TEA", "4", "What?", work("slots", slots=SLOT)), ("Jazz with TEA", None, None)),
    "slot without support": (("tea", "4", "What?", work("slots", slots=[("a", "rum", "likes rum")])), ("tea", None, "slot without support")),
    "infer": (("Paris", "3", "Where?", work("infer", candidates=GUESS, chosen=0)), ("Likely Berlin", "Paris", None)),
    "infer told already": (("in berlin", "3", "Where?", work("infer", candidates=GUESS, chosen=0)), ("in berlin", None, None)),
    "infer unsupported": (("Paris", "3", "Where?", work("infer", candidates=GUESS, chosen=1)), ("Paris", None, "candidate without support")),
    "infer contradicted": (("Paris", "3", "Where?", work("infer", candidates=GUESS, chosen=2)), ("Paris", None, "candidate contradicted")),
    "infer without quotes": (("Paris", "3", "Where?", work("infer", candidates=GUESS, chosen=3)), ("Paris", None, "candidate without support")),
    "nothing chosen": (("Paris", "3", "Where?", work("infer", candidates=GUESS, chosen=9)), ("Paris", None, "no candidate")),
    "no work": (("Paris", "3", "Where?", None), ("Paris", None, "no work")),
    "unknown work": (("Paris", "3", "Where?", work("sum")), ("Paris", None, None)),
}


def test_executors(spark):
    rows = [(name, a, c, q, CONTEXT, w) for name, ((a, c, q, w), _) in CASES.items()]
    df = spark.createDataFrame(rows, f"name string, answer string, category string, question string, context string, work {X.WORK}")
    got = {r.name: (r.answer, r.model_answer, r.warning) for r in X.executed(df).collect()}
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_leaves_walk_any_nesting(spark):
    df = spark.createDataFrame([Row(k=1, p=Row(a="x", b=Row(c=2, d=None), e={"z": Row(f=" "), "y": Row(f="w")}, g=[Row(h=True), Row(h=None)])), Row(k=2, p=None)], "k long, p struct<a: string, b: struct<c: int, d: string>, e: map<string, struct<f: string>>, g: array<struct<h: boolean>>>")
    assert sorted((r.k, r.path, r.value) for r in PF.leaves(df, ["k"], "p").collect()) == [(1, "a", "x"), (1, "b.c", "2"), (1, "e.y.f", "w"), (1, "g.1.h", "true")]
    assert PF.leaves(df.where(F.col("k") > 2), ["k"], "p").collect() == []
