"""Nodes by scope and id, neighbours in other scopes, and lookups that need no edge: by entities, in time, and of the evidence itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions.shared import stored

from .runtime import navigation_score
from .search import ranked
from .temporal import neighbours, overlapping
from .windows import running

HEAD = "chain_head"


def listed(nodes: DataFrame, scopes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Nodes of the scopes (scope), of some kinds or all, with place: by chain, starts, valid_from and id."""
    own = nodes.join(scopes.select("scope").distinct(), "scope", "left_semi")
    own = own.where(F.col("kind").isin(*kinds)) if kinds else own
    return running(own, ["scope"], ["chain", "starts", "valid_from", "id"], F.lit(1).cast("long"), "place")


def fetched(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """The nodes that each request (probe, ids) names, in its order; an id that is named twice comes once, an unknown one not at all."""
    wanted = requests.select("probe", F.posexplode(F.array_distinct("ids")).alias("place", "id"))
    return wanted.join(nodes, "id")


def facts_of(facts: DataFrame, states: DataFrame) -> DataFrame:
    """Facts (scope, state, id, valid_from ...) of the states asked for (scope, state; a null state asks for all of the scope's), with place in their scope."""
    some = facts.join(states.where("state IS NOT NULL").select("scope", "state").distinct(), ["scope", "state"], "left_semi")
    whole = states.where("state IS NULL").select("scope").distinct()
    every = facts.join(whole, "scope", "left_semi").unionByName(some.join(whole, "scope", "left_anti"))
    return running(every, ["scope"], ["valid_from", "id"], F.lit(1).cast("long"), "place")


def retrieves(kind: Column, semantic: bool = True) -> Column:
    """Whether a node is retrieved at all: without semantic nodes only events are."""
    return F.lit(True) if semantic else ~kind.isin(HEAD, "semantic_state")


def cross_adjacent(edges: DataFrame, anchors: DataFrame, types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """anchor, edge, type, neighbour and neighbour_scope over edges between scopes (id, source, source_scope, target, target_scope, type).

    anchors has scope and anchor. An edge whose ends are both asked for leads from its source to its target only.
    """
    own = edges.where(F.upper("type").isin(*(t.upper() for t in types))) if types else edges
    way = lambda a, b: own.select(F.col(a).alias("anchor"), F.col(f"{a}_scope").alias("scope"), F.col("id").alias("edge"), "type", F.col(b).alias("neighbour"), F.col(f"{b}_scope").alias("neighbour_scope"))
    asked = anchors.select("scope", "anchor").distinct()
    out, back = way("source", "target").join(asked, ["scope", "anchor"], "left_semi"), way("target", "source").join(asked, ["scope", "anchor"], "left_semi")
    if direction == "out":
        return out
    if direction == "in":
        return back
    return out.unionByName(back.join(out.select("edge").distinct(), "edge", "left_anti"))


def fetch_limit(action: Column, budget: Column) -> Column:
    """How many rows a lookup reads before they are filtered and scored: twice or four times the budget, 32 at most."""
    return F.least(F.lit(32), F.greatest(budget, F.lit(1)) * F.when(action == "ENTITY_LOOKUP", 2).otherwise(4))


def coverage(anchor: Column, other: Column) -> Column:
    """Share of the anchor's distinct entities that the other node has."""
    return C.overlap_share(anchor, other)


def asked_entities(names: Column, ids: Column, question: Column, least: int = 2) -> Column:
    """Ids of the anchor's entities that the question names, if there are `least`; else its first `least`."""
    said = F.filter(F.arrays_zip(names.alias("name"), ids.alias("id")), lambda e: (F.trim(e["name"]) != "") & F.contains(F.lower(question), F.lower(e["name"])))
    named = F.array_distinct(F.transform(said, lambda e: e["id"]))
    return F.when(F.size(named) >= least, named).otherwise(F.slice(F.array_distinct(ids), 1, least))


def visible(scope: Column, other: Column, evidence: Column, other_evidence: Column, members: Column, other_members: Column) -> Column:
    """Whether a node of another scope may be seen: both nodes have evidence, and each's speakers belong to the other's scope too."""
    within = lambda a, b: (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)
    return (scope == other) | (within(evidence, other_members) & within(other_evidence, members))


def lookups(anchors: DataFrame, nodes: DataFrame, max_days: int = 3650) -> DataFrame:
    """anchor, action, id, score and rank: what the lookups find for anchors, best first, up to each one's budget.

    nodes: id, space (what may be searched together), scope, kind, starts, ends (null: as starts), reliable (its time),
    entity_ids, entities (names), confidence, words (distinct, lower case), evidence (speakers of its evidence) and
    members (of its scope). anchors: anchor (a node's id), action, budget and question; an anchor's actions are rows.
    A lookup reads its first rows in its own order, drops the anchor, heads and what isn't visible, scores, and cuts.
    Nodes are read several times, so give them as a stored table; the anchors' own lists are stored here, which runs jobs
    before this returns.
    """
    own = nodes.where(F.col("kind") != HEAD)
    last = F.coalesce("ends", "starts")
    asked = anchors.join(nodes.withColumnRenamed("id", "anchor"), "anchor").withColumn("limit", fetch_limit(F.col("action"), F.col("budget")))
    asked = stored(asked)  # a row an anchor and action; all lookups begin from it
    of = lambda *actions: asked.where(F.col("action").isin(*actions))
    by_scope = [F.asc_nulls_first("scope"), F.asc_nulls_first("starts"), F.col("id")]

    def entities(wanted: DataFrame, every: bool, only: list[str]) -> DataFrame:
        at = wanted.select("space", "anchor", "action", "limit", F.size("want").alias("k"), F.explode("want").alias("entity"))
        has = own.where(F.col("kind").isin(*only)).select("space", "id", "scope", "starts", F.explode(F.array_distinct("entity_ids")).alias("entity"))
        met = at.join(has, ["space", "entity"]).groupBy("anchor", "action", "limit", "k", "id", "scope", "starts").agg(F.count("*").alias("n"))
        met = met.where("n = k") if every else met
        return ranked(met, ["anchor", "action"], by_scope, F.col("limit"), "n").select("anchor", "action", "id")

    dated = own.where("kind = 'event' AND starts IS NOT NULL AND reliable")
    times = of("TIME_OVERLAP_LOOKUP", "TEMPORAL_BEFORE_LOOKUP", "TEMPORAL_AFTER_LOOKUP", "NEAREST_TIME_LOOKUP").where("kind = 'event' AND starts IS NOT NULL")
    spans = dated.select("space", "id", "scope", "starts", F.col("starts").alias("rs"), last.alias("re"))
    covering = overlapping(times.where("(action = 'TIME_OVERLAP_LOOKUP' AND ends IS NOT NULL) OR action = 'NEAREST_TIME_LOOKUP'").select("space", "anchor", "action", "limit", F.col("starts").alias("ls"), F.when(F.col("action") == "NEAREST_TIME_LOOKUP", F.col("starts")).otherwise(F.col("ends")).alias("le")), spans, ["space"])
    covering = stored(covering)
    overlaps = ranked(covering.where("action = 'TIME_OVERLAP_LOOKUP'"), ["anchor", "action"], by_scope, F.col("limit"), "n").select("anchor", "action", "id")
    now = ranked(covering.where("action = 'NEAREST_TIME_LOOKUP'"), ["anchor"], [F.col("starts"), F.col("id")], F.col("limit"), "n").select("anchor", "action", "id", "limit", "starts", F.lit(0).cast("long").alias("far"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))

    def beside(actions: tuple[str, ...], side: str) -> DataFrame:
        # before ends strictly earlier; after begins strictly later than the anchor ends (nearest: than it begins)
        marks = times.where(F.col("action").isin(*actions)).withColumn("_ref", F.when((F.col("action") == "TEMPORAL_AFTER_LOOKUP"), last).otherwise(F.col("starts")))
        at = F.col("_ref") - F.expr("INTERVAL 0.000001 SECOND") if side == "before" else F.col("_ref")
        # an anchor may ask twice, as an action or as a part of "nearest": each has a row
        keyed = marks.select("space", F.struct("anchor", "action").alias("who"), "limit", "_ref", at.alias("at"))
        numbered = keyed.withColumn("anchor", F.xxhash64("who"))
        rows = dated.select("space", "id", (last if side == "before" else F.col("starts")).alias("ts"))
        near = neighbours(numbered.select("space", "anchor", "at"), rows, ["space"], 32, side)
        near = near.join(numbered.select("anchor", "who", "limit", "_ref"), "anchor").where(F.col("rank") <= F.col("limit"))
        gap = F.when(F.lit(side == "before"), near["gap_us"] + 1).otherwise(near["gap_us"])
        return near.select("who.anchor", "who.action", "id", "limit", gap.alias("far")).where(F.col("far") <= F.lit(max_days * 86_400_000_000))

    before, after = beside(("TEMPORAL_BEFORE_LOOKUP", "NEAREST_TIME_LOOKUP"), "before"), beside(("TEMPORAL_AFTER_LOOKUP", "NEAREST_TIME_LOOKUP"), "after")
    sides = stored(before.unionByName(after))
    nearest = sides.where("action = 'NEAREST_TIME_LOOKUP'").join(dated.select("id", "starts"), "id").select("anchor", "action", "id", "limit", "starts", "far").unionByName(now)
    nearest = ranked(nearest, ["anchor"], [F.col("far"), F.col("starts"), F.col("id")], F.col("limit"), "n").select("anchor", "action", "id")
    cross = of("CROSS_ENTITY_LOOKUP").withColumn("want", asked_entities(F.col("entities"), F.col("entity_ids"), F.col("question"))).where(F.size("want") >= 2)
    found = entities(of("ENTITY_LOOKUP").withColumn("want", F.array_distinct("entity_ids")), False, ["event", "semantic_state"])
    for more in (entities(cross, True, ["event"]), overlaps, sides.where("action <> 'NEAREST_TIME_LOOKUP'").select("anchor", "action", "id"), nearest):
        found = found.unionByName(more)
    columns = ("scope", "starts", "ends", "entity_ids", "evidence", "members")
    met = found.where("id <> anchor").join(asked.select("anchor", "action", "budget", "question", *(F.col(c).alias(f"a_{c}") for c in columns)), ["anchor", "action"]).join(own.select("id", "confidence", "words", *columns), "id")
    met = met.where(visible(F.col("a_scope"), F.col("scope"), F.col("a_evidence"), F.col("evidence"), F.col("a_members"), F.col("members")))
    a_last = F.coalesce("a_ends", "a_starts")
    gap = F.greatest(F.lit(0), micros(F.col("a_starts")) - micros(last), micros(F.col("starts")) - micros(a_last)) / 1e6
    close = F.when(F.col("action").isin("ENTITY_LOOKUP", "CROSS_ENTITY_LOOKUP"), 0.0).otherwise(F.coalesce(C.proximity(gap), F.lit(0.0)))
    like = C.overlap_share(C.tokens(F.col("question")), F.col("words"))
    score = navigation_score(like, F.when(F.size("a_entity_ids") > 0, coverage(F.col("a_entity_ids"), F.col("entity_ids"))).otherwise(0.0), close, F.col("confidence"), F.col("action"))
    return ranked(met.select("anchor", "action", "id", F.round(score, 6).alias("score"), "budget"), ["anchor", "action"], [F.desc("score"), F.col("id")], F.col("budget")).drop("budget")


def evidence_of(anchors: DataFrame, records: DataFrame) -> DataFrame:
    """anchor, id, record, content, starts, score and rank: the records behind nodes, as events of their own.

    anchors: anchor, budget, question (or null), starts. records: node, record, content, speaker, turn, starts. A record scores
    0.6 and 0.4 times the share of the question's words that it has (0.85 without a question); empty ones are left out.
    """
    at = records.where("trim(coalesce(content, '')) <> ''").join(anchors.withColumnRenamed("starts", "anchor_starts"), F.col("node") == F.col("anchor"))
    title = F.when(F.coalesce(F.col("turn").cast("string"), F.lit("")) != "", F.concat(F.lit("Source evidence turn "), F.col("turn").cast("string"))).otherwise("Source evidence")
    words = F.array_distinct(C.tokens(F.concat_ws(" ", title, F.col("content"))))
    like = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", 0.85).otherwise(C.overlap_share(C.tokens(F.col("question")), words))
    name = C.stable_id("source_evidence", F.col("anchor"), F.coalesce(F.col("record").cast("string"), F.col("content")))
    made = at.select("anchor", "budget", name.alias("id"), "record", title.alias("title"), "content", F.coalesce("starts", "anchor_starts").alias("starts"), F.round(F.least(F.lit(1.0), 0.60 + 0.40 * like), 6).alias("score"))
    return ranked(made, ["anchor"], [F.desc("score"), F.col("id")], F.col("budget")).drop("budget")
