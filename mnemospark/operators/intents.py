"""What a question asks for, by rules: its classes, the facets an answer needs, budgets, which edges go first, and the moves that are open."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.columns import once

#: Patterns of each class of questions, in the order in which classes give facets.
PATTERNS = {
    "who": (r"\bwho(?:m|se)?\b", r"\bwhich (?:person|people|participant)\b", "谁", "哪位", "哪些人", "参与者"),
    "where": (r"\bwhere\b", r"\b(?:which|what) (?:place|location)\b", "哪里", "哪儿", "何处", "什么地方", "地点"),
    "when": (r"\bwhen\b", r"\bwhat (?:time|date|day|year|month)\b", "什么时候", "何时", "哪天", "哪一年", "几点"),
    "current_latest": (r"\bcurrent(?:ly)?\b", r"\blatest\b", r"\bmost recent\b", r"\bnow\b", "当前", "现在", "最新", "最近", "目前"),
    "before_after": (r"\bbefore\b", r"\bafter\b", r"\bnext\b", r"\bprevious(?:ly)?\b", "之前", "之后", "前后", "后来", "此前", "随后", "接下来"),
    "why_how": (r"\bwhy\b", r"\bhow\b", r"\breason\b", r"\bcause[ds]?\b", "为什么", "为何", "原因", "怎么", "如何"),
    "count_list": (r"\bhow many\b", r"\blist\b", r"\bwhich\b", r"\ball\b", r"\bname (?:the|all)\b", "多少", "几个", "列出", "哪些", "所有", "全部", "清单"),
    "hypothetical_reasoning": (
        r"\bwould\b", r"\bmight\b", r"\bcould\b", r"\blikely\b", r"\bconsidered\b", r"\battributes\b", r"\bprefer(?:s|red)?\b", r"\bpersonality\b", r"\bopen to\b", r"\binterested in\b",
        "会", "可能", "也许", "会不会",
    ),
    "comparison": (r"\bor\b", r"\bversus\b", r"\bvs\.?\b", r"\bcompare[sd]?\b", "还是", "或者", "比较"),
    "simultaneous": (r"\bsimultaneous(?:ly)?\b", r"\bat the same time\b", r"\bwhile\b", r"\boverlap(?:ping)?\b", "同时", "同期", "同一时间", "重叠", "期间"),
    "nearest_time": (r"\bnearest\b", r"\bclosest\b", r"\baround (?:that|this) time\b", "最接近", "最近的时间", "前后发生"),
    "cross_entity": (r"\bbetween\b.+\band\b", r"\brelationship between\b", r"\bcompare\b.+\b(?:and|with)\b", "之间", "关系", "比较"),
}
#: What makes a question complex by itself, and in which direction it looks.
COMPLEX = (r"\b(?:and|then|also|compare|relationship|across)\b", "并且", "并", "以及", "然后", "比较", "关系", "多跳")
BEFORE = (r"\bbefore\b", r"\bprevious(?:ly)?\b", "之前", "此前", "前面", "先前", "以前")
AFTER = (r"\bafter\b", r"\bnext\b", "之后", "后来", "随后", "接下来", "以后")
#: The facets of each class, and the edges that answer it, in order.
FACETS = {
    "who": ("actor",), "where": ("location",), "when": ("time",), "current_latest": ("state", "time"), "before_after": ("time", "action"), "why_how": ("cause", "outcome"), "count_list": ("count",),
    "hypothetical_reasoning": ("state", "cause"), "comparison": ("state", "object"), "simultaneous": ("time",), "nearest_time": ("time", "action"), "cross_entity": ("actor", "object"),
}
CAUSAL = ("CAUSES", "CONTRIBUTES_TO", "ENABLES", "CONTEXT_FOR")
TEMPORAL, CURRENT, HISTORY, SUPPORT = ("TEMPORAL_NEXT",), ("CURRENT_STATE",), ("SEMANTIC_NEXT", "INITIAL_STATE"), ("SUPPORTED_BY", "SUPPORTS_STATE")
OTHERS = ("TRIGGERS_STATE_CHANGE", "SUPERSEDES", "CONTRADICTS", "FOLLOW_UP_OF", "SAME_EVENT", "PART_OF", "AFFECTS_TOPIC")
HARD = ("count_list", "why_how", "complex", "hypothetical_reasoning", "comparison")
#: Priorities of the lookups that need no edge.
LOOKUPS = {
    "SOURCE_EVIDENCE_LOOKUP": 880, "TEMPORAL_BEFORE_LOOKUP": 890, "TEMPORAL_AFTER_LOOKUP": 891, "NEAREST_TIME_LOOKUP": 892, "CROSS_ENTITY_LOOKUP": 899, "ENTITY_LOOKUP": 900, "TIME_OVERLAP_LOOKUP": 901,
}


def _begins(pattern: str) -> list[str] | None:
    """Plain strings of which a text must have one for the pattern to hold, from how the pattern begins; None where that isn't plain."""
    if "|" in re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", pattern)):
        return None
    rest = pattern.removeprefix(r"\b")
    if some := re.match(r"\(\?:([^()\\\[\]?*+.{}^$]+)\)(?![?*+{])", rest):
        return some[1].split("|")
    plain = re.match(r"[^()|\\\[\]?*+.{}^$]*", rest)[0]
    if plain and rest[len(plain) : len(plain) + 1] in ("?", "*", "+", "{"):
        plain = plain[:-1]
    return [plain] if plain else None


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern holds. Most texts lack the strings that patterns begin with, and looking for those is far quicker."""
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    has = lambda p: either(F.contains(text, F.lit(s)) for s in _begins(p)) & text.rlike(p) if _begins(p) else text.rlike(p)
    return either(F.contains(text, F.lit(p)) if _begins(p) == [p] else has(p) for p in patterns)


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("CAST(array() AS array<string>)")


def question(text: Column) -> Column:
    """The question with single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def classes(text: Column) -> Column:
    """The classes of a question (array, in the order of PATTERNS), and "complex" if it has two or more or says so."""
    low = F.lower(question(text))
    return _with_complex(low, _own(low))


def _own(low: Column) -> Column:
    return F.array_compact(F.array(*(F.when(_any(low, p), name) for name, p in PATTERNS.items())))


def _with_complex(low: Column, own: Column) -> Column:
    return F.when((F.size(own) >= 2) | _any(low, COMPLEX), F.array_append(own, "complex")).otherwise(own)


def facets(kinds: Column) -> Column:
    """What an answer must cover, each once; state and cause where nothing is recognised."""
    found = F.array_distinct(F.flatten(F.array(*(F.when(F.array_contains(kinds, name), _strings(*own)).otherwise(_strings()) for name, own in FACETS.items()))))
    return F.when(F.size(found) == 0, _strings("state", "cause")).otherwise(found)


def is_complex(kinds: Column) -> Column:
    return (F.size(kinds) == 0) | F.arrays_overlap(kinds, _strings(*HARD))


def edge_priorities(kinds: Column) -> Column:
    """All edge types, those first that answer the question's classes."""
    when = lambda test, edges: F.when(test, _strings(*edges)).otherwise(_strings())
    has = lambda *names: F.arrays_overlap(kinds, _strings(*names))
    first = (when((F.size(kinds) == 0) | has("why_how", "hypothetical_reasoning", "comparison"), CAUSAL), when(has("before_after"), TEMPORAL), when(has("current_latest"), CURRENT), when(has("current_latest", "before_after"), HISTORY))
    return F.array_distinct(F.concat(*first, _strings(*SUPPORT, *CAUSAL, *TEMPORAL, *CURRENT, *HISTORY, *OTHERS)))


def analysed(questions: DataFrame) -> DataFrame:
    """questions (probe, text) with kinds, facets, complexity, probe_budget, edges and whether entity and overlap lookups are open."""
    return _analysed(questions).drop("_low")


def _analysed(questions: DataFrame) -> DataFrame:
    """As analysed, with _low: the question in lower case. That, its own classes and all its classes are each worked out once."""
    df = once(questions, "_low", F.lower(question(F.col("text"))))
    df = once(once(df, "_own", _own(F.col("_low"))), "kinds", _with_complex(F.col("_low"), F.col("_own"))).drop("_own")
    hard = is_complex(F.col("kinds"))
    return df.select(
        "*", facets(F.col("kinds")).alias("facets"), F.when(hard, "complex").otherwise("simple").alias("complexity"), F.when(hard, 12).otherwise(8).alias("probe_budget"), edge_priorities(F.col("kinds")).alias("edges"),
        F.array_contains("kinds", "count_list").alias("by_entity"), F.array_contains("kinds", "simultaneous").alias("by_overlap"),
    )


def catalog(questions: DataFrame, results: DataFrame) -> DataFrame:
    """probe, action_id (a1, a2 ...), source, action and direction: every move that is open to a question, best first.

    questions has probe and text. results has probe, source (a result's reference), node_type, starts, ends,
    has_evidence and options (array of edge_type, direction). Moves are the edges at hand, by the question's priorities,
    and then lookups that fit the node and the question; each move is listed once, results without reference give none.
    """
    # what the text tells is worked out once a question; the text itself meets no result
    told = once(_analysed(questions.select("probe", "text")), "_told", F.struct(_any(F.col("_low"), BEFORE).alias("before"), _any(F.col("_low"), AFTER).alias("after")))
    asked = told.select("probe", "_told", "kinds", "edges", "by_entity", "by_overlap")
    at = results.where("coalesce(source, '') <> ''").join(asked, "probe")
    kinds, before, after = F.col("kinds"), F.col("_told.before"), F.col("_told.after")
    turned = F.when(before & ~after, "in").otherwise("out")
    edge = at.select("probe", "source", "kinds", "edges", turned.alias("turned"), F.inline("options")).withColumn("action", F.upper("edge_type")).withColumn("direction", F.lower("direction"))
    edge = edge.where("coalesce(action, '') <> '' AND direction IN ('in', 'out')")
    place = F.array_position("edges", F.col("action"))
    unlike = (F.col("action") == "TEMPORAL_NEXT") & F.array_contains("kinds", "before_after") & (F.col("direction") != F.col("turned"))
    edge = edge.select("probe", "source", "action", "direction", F.when(place > 0, place - 1).otherwise(999).cast("long").alias("priority"), unlike.cast("int").alias("turn"))
    event, dated = F.col("node_type") == "event", F.coalesce(F.col("starts").cast("string"), F.lit("")) != ""
    ended, memory = F.coalesce(F.col("ends").cast("string"), F.lit("")) != "", F.col("node_type").isin("event", "semantic_state")
    asks = lambda name: F.array_contains(kinds, name)
    tests = {
        "SOURCE_EVIDENCE_LOOKUP": F.col("has_evidence"), "TEMPORAL_BEFORE_LOOKUP": event & dated & asks("before_after") & before, "TEMPORAL_AFTER_LOOKUP": event & dated & asks("before_after") & after,
        "NEAREST_TIME_LOOKUP": event & dated & asks("nearest_time"), "CROSS_ENTITY_LOOKUP": memory & asks("cross_entity"), "ENTITY_LOOKUP": memory & F.col("by_entity"), "TIME_OVERLAP_LOOKUP": event & dated & ended & F.col("by_overlap"),
    }
    moves = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("action"), F.lit(LOOKUPS[name]).cast("long").alias("priority"))) for name, test in tests.items())))
    looked = at.select("probe", "source", F.inline(moves)).select("probe", "source", "action", F.lit("lookup").alias("direction"), "priority", F.lit(0).alias("turn"))
    listed = edge.unionByName(looked).groupBy("probe", "source", "action", "direction").agg(F.min("priority").alias("priority"), F.min("turn").alias("turn"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("priority", "turn", "source", "action", "direction"))
    return listed.select("probe", rank.alias("place"), "source", "action", "direction").select("probe", F.concat(F.lit("a"), F.col("place").cast("string")).alias("action_id"), "source", "action", "direction")


def first_open(moves: DataFrame, tried: DataFrame) -> DataFrame:
    """The rule that chooses where no model does: each probe's first move that is not among tried (probe, source, action, direction).

    moves are what catalog gives, with local (whether the result belongs to what is asked, rather than to another part
    of the question) and wants_source (whether a facet is missing). Local moves go first; within them, where a facet is
    missing, the evidence itself goes before links; then the catalogue's order holds.
    """
    left = moves.join(tried.select("probe", "source", "action", "direction"), ["probe", "source", "action", "direction"], "left_anti")
    source = F.col("wants_source") & (F.col("action") == "SOURCE_EVIDENCE_LOOKUP")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(~F.col("local"), ~source, F.expr("CAST(substring(action_id, 2) AS long)")))
    return left.withColumn("n", rank).where("n = 1").select("probe", "action_id", "source", "action", "direction")


def pattern_sql(patterns: tuple[str, ...], text: str) -> str:
    """A test in SQL, for engines whose \\b knows ASCII only: word edges are written out."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    out = [(f"(?:^|{edge})" + p[2:] if p.startswith(r"\b") else p) for p in patterns]
    out = [(p[:-2] + f"(?:$|{edge})" if p.endswith(r"\b") else p).replace(r"\b.+\b", f"{edge}(?:.*{edge})?") for p in out]
    return "(" + reduce(lambda a, b: f"{a} OR {b}", (f"regexp_matches({text}, '{p}')" for p in out)) + ")"
