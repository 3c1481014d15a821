"""The planner's loop for all questions at once: assess what is missing, choose moves and probes, search, count growth, stop.

Where a model would plan, rules do, so a run is the same each time. A question has a target `root` and further ones for
its parts; every round is one plan over all targets of all questions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions.lazy import pd
from mnemospark.functions.shared import shared_dir, stored

from .records import fingerprint
from .search import ranked

#: Probes (question, target, query, must, should, entities) -> (question, target, id, score).
Search = Callable[[DataFrame], DataFrame]
KEY = ["question", "target"]
PROBE = ["query", "must", "should", "entities"]


def _entity_like(term: Column, entities: Column) -> Column:
    """Whether a must term is an entity or lies in the name of one: such terms are never eased."""
    return F.exists(entities, lambda e: F.contains(C.collapsed(e), C.collapsed(term)) & (C.collapsed(term) != ""))


def eased(must: Column, entities: Column) -> tuple[Column, Column]:
    """The must terms that stay, and those that become should terms."""
    return F.filter(must, lambda t: _entity_like(t, entities)), F.filter(must, lambda t: ~_entity_like(t, entities))


def relaxed(probes: DataFrame) -> DataFrame:
    """Probes whose must terms, but for entities, only count from now on and exclude nothing; those without such terms go."""
    stay, go = eased(F.col("must"), F.col("entities"))
    return probes.withColumns({"_stay": stay, "_go": go}).where(F.size("_go") > 0).withColumns({"must": F.col("_stay"), "should": F.array_distinct(F.concat("should", "_go"))}).drop("_stay", "_go")


def diversified(probes: DataFrame) -> DataFrame:
    """Probes turned to what is missing (column missing): the entities, the query and the missing facets make the new query,
    and must terms but for entities, and the facets, become should terms."""
    stay, go = eased(F.col("must"), F.col("entities"))
    facets = F.when(F.size("missing") > 0, F.array_join("missing", " ")).otherwise("related")
    query = F.array_join(F.filter(F.array(F.array_join("entities", " "), F.trim("query"), F.concat(facets, F.lit(" supporting evidence"))), lambda x: x != ""), " ")
    return probes.withColumns({"query": query, "must": stay, "should": F.array_distinct(F.concat("should", go, "missing"))})


def spread(probes: DataFrame, budget: int, most: int = 64) -> DataFrame:
    """The `budget` probes of each target (question, target, probe, terms, score) that differ most, with their place.

    The best by score goes first; then always the one whose least distance (1 - Jaccard of the terms) to those chosen is
    the largest, ties by score, then probe. Of each target the best `most` are looked at, which bounds a group.
    """
    few = ranked(probes.select(*KEY, "probe", "terms", "score"), KEY, [F.desc("score"), F.col("probe")], most, "n").drop("n")
    kinds = {f.name: f.dataType.simpleString() for f in few.schema}

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "probe"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets, left, out = [set(t) for t in rows["terms"]], list(range(len(rows))), []
        gap = [2.0] * len(rows)
        while left and len(out) < budget:
            i = max(left, key=lambda j: (gap[j], -j))
            out.append(i)
            left.remove(i)
            for j in left:
                both = len(sets[i] | sets[j])
                gap[j] = min(gap[j], 1 - len(sets[i] & sets[j]) / both if both else 0.0)
        rows = rows.iloc[out]
        return rows[[*KEY, "probe"]].assign(place=range(1, len(out) + 1))

    return few.groupBy(*KEY).applyInPandas(chosen, f"question {kinds['question']}, target {kinds['target']}, probe {kinds['probe']}, place long")


def by_terms(nodes: DataFrame) -> Search:
    """A search over nodes (question, id, term, a row a term): a node must have all must terms, and scores a point for each
    of them, for each should term and each entity, over how many the probe asks for. Terms are compared as they stand."""

    def search(probes: DataFrame) -> DataFrame:
        asked = probes.select(*KEY, F.size(F.array_distinct("must")).alias("need"), F.size(F.array_distinct(F.concat("must", "should", "entities"))).alias("all"), F.explode(F.array_distinct(F.concat("must", "should", "entities"))).alias("term"), "must")
        met = asked.withColumn("due", F.array_contains("must", F.col("term"))).drop("must").join(nodes.select("question", "id", "term"), ["question", "term"]).distinct()
        scored = met.groupBy(*KEY, "id").agg(F.count("*").alias("n"), F.count_if("due").alias("got"), F.first("need").alias("need"), F.first("all").alias("all"))
        return scored.where("got = need").select(*KEY, "id", F.round(F.col("n") / F.col("all"), 6).alias("score"))

    return search


def run(targets: DataFrame, search: Search, moves: DataFrame, facets: DataFrame, rounds: int = 8, barren: int = 2, first: int = 12, later: int = 6, actions: int = 3, reach: int = 4, limit: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence (question, id, score, turn, cited, rank), outcome (question, reason, rounds) and log (question, target, round,
    missing, probe, moves, growth).

    targets: question, target, required, facets (what it must learn), query, must, should, entities (arrays of strings); a
    question without a target `root` is ended by its required targets alone. moves: source, action, direction, priority,
    id, score: what an action from a node reaches; of each the `reach` best count. facets: id, facet: what a node tells.

    First each target's probe finds its `first` best nodes. A round, of at most `rounds`:
    1. Assess: a target is sufficient if the nodes found for it (for root: for any target) tell all its facets. A question ends
       when root and all required targets are sufficient (sufficient), or when none that isn't can act (exhausted).
    2. Move: each target that can act takes its first `actions` moves that it hasn't tried from any node of the question,
       those from its own nodes first, then SOURCE_EVIDENCE_LOOKUP, then by priority, source, action and direction.
    3. Probe: after a round without growth a required part may ask again, once: its probe relaxed or, if nothing can be
       relaxed, diversified; unless it asked just that before.
    4. Growth: nodes that the question hadn't. After `barren` rounds without any a target is exhausted, at once if it has
       neither moves nor a probe; it comes back when others find nodes with moves that it hasn't tried.

    What is cited (a target's best node for each facet) ranks first, then the score, then the id; `limit` rows a question.
    Questions end by themselves and drop out; no round's work grows with those that have ended. What a round finds out, moves
    and finds is written to the shared folder; it is all that later rounds read. Ties go to the smaller id; null arrays count as empty.
    """
    shared_dir(targets.sparkSession)
    none = F.array().cast("array<string>")
    arrays = ("facets", "must", "should", "entities")
    print_ = lambda: fingerprint(F.col("query"), F.array_distinct(F.col("must")), F.concat("entities", F.transform("should", lambda s: F.concat(F.lit("~"), s))), F.lit(None).cast("string"), F.lit(None).cast("string"))
    start = targets.select(*KEY, "required", *PROBE[:1], *(F.coalesce(c, none).alias(c) for c in arrays))
    state = start.withColumns({"stage": F.lit(0), "zero": F.lit(0), "out_at": F.lit(-1), "prints": F.array(print_())}).checkpoint()
    best_moves = stored(ranked(moves.select("source", "action", "direction", "priority", "id", "score"), ["source", "action", "direction"], [F.desc("score"), F.col("id")], reach, "n").drop("n"))
    paths = stored(best_moves.groupBy("source", "action", "direction").agg(F.min("priority").alias("priority")))
    tells = facets.select("id", "facet").distinct()
    order = [F.desc("local"), F.desc(F.col("action") == "SOURCE_EVIDENCE_LOOKUP"), F.col("priority"), F.col("source"), F.col("action"), F.col("direction")]
    found = ranked(search(state.select(*KEY, *PROBE)), KEY, [F.desc("score"), F.col("id")], first, "n").drop("n")
    pool = found.withColumns({"score": F.col("score").cast("double"), "turn": F.lit(0)}).checkpoint()
    tried, ended, log = [], [], []
    for turn in range(1, rounds + 1):
        known = pool.groupBy("question", "id").agg(F.max("score").alias("score"), F.min("turn").alias("turn"))
        told = _told(pool, tells)
        at = state.join(told, KEY, "left").withColumn("missing", F.array_sort(F.array_except("facets", F.coalesce("told", none)))).drop("told")
        # moves that a target hasn't tried, from all nodes of its question
        ready = _open(at.where("size(missing) > 0 AND (target = 'root' OR required)"), pool, known, paths, _all(tried))
        # of each target only the moves it may take now, and the turn of its newest
        ready = stored(ranked(ready.withColumn("newest", F.max("turn").over(Window.partitionBy(*KEY))), KEY, order, actions, "n").drop("n"))
        fresh = ready.groupBy(*KEY).agg(F.max("newest").alias("newest"))
        at = at.join(fresh, KEY, "left").withColumn("acts", F.expr("size(missing) > 0 AND (target = 'root' OR required) AND (out_at < 0 OR coalesce(newest >= out_at, FALSE))")).checkpoint()
        whole = at.groupBy("question").agg(F.max(F.expr("size(missing) > 0 AND (target = 'root' OR required)")).alias("open"), F.max("acts").alias("can"))
        over = whole.where("NOT open OR NOT can").select("question", F.when(~F.col("open"), "sufficient").otherwise("exhausted").alias("reason"), F.lit(turn - 1).alias("rounds"))
        ended.append(over)
        state = at.join(over.select("question"), "question", "left_anti").drop("newest")
        now = state.where("acts")
        if not now.limit(1).count():
            break
        # probes asked again
        again = now.where("required AND target <> 'root' AND zero > 0 AND stage = 0").select(*KEY, *PROBE, "missing", "prints")
        eased_ = relaxed(again)
        turned = diversified(again.join(eased_.select(*KEY), KEY, "left_anti"))
        asked = eased_.withColumn("how", F.lit("relaxed")).unionByName(turned.withColumn("how", F.lit("diversified"))).withColumn("print", print_())
        asked = asked.where(~F.array_contains("prints", F.col("print"))).drop("prints", "missing").checkpoint()
        # moves made
        taken = ready.join(now.select(*KEY), KEY, "left_semi").select(*KEY, "source", "action", "direction").checkpoint()
        tried.append(taken)
        gained = taken.join(best_moves, ["source", "action", "direction"]).select(*KEY, "id", F.col("score").cast("double").alias("score"))
        if asked.limit(1).count():
            gained = gained.unionByName(ranked(search(asked.select(*KEY, *PROBE)), KEY, [F.desc("score"), F.col("id")], later, "n").select(*KEY, "id", F.col("score").cast("double").alias("score")))
        gained = gained.groupBy(*KEY, "id").agg(F.max("score").alias("score"))
        new = gained.join(pool.select(*KEY, "id"), [*KEY, "id"], "left_anti").withColumn("turn", F.lit(turn)).checkpoint()
        growth = new.join(known.select("question", "id"), ["question", "id"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("growth"))
        pool = pool.unionByName(new)
        # what the round did to each target
        did = taken.groupBy(*KEY).agg(F.count("*").alias("moves"))
        seen = state.join(did, KEY, "left").join(growth, KEY, "left").join(asked.select(*KEY, *(F.col(c).alias(f"_{c}") for c in PROBE), "how", "print"), KEY, "left")
        seen = seen.na.fill(0, ["moves", "growth"]).withColumn("idle", F.expr("moves = 0 AND how IS NULL"))
        seen = seen.withColumn("_zero", F.when(~F.col("acts"), F.col("zero")).when(F.col("growth") > 0, 0).otherwise(F.col("zero") + 1))
        rows = seen.where("acts").select(*KEY, F.lit(turn).alias("round"), "missing", "how", "moves", "growth")
        log.append(rows)
        # a part that may still ask again isn't out for want of moves
        may_ask = F.expr("required AND target <> 'root' AND stage = 0 AND zero = 0")
        out_at = F.when(~F.col("acts"), F.col("out_at")).when((F.col("_zero") >= barren) | (F.col("idle") & ~may_ask), F.lit(turn)).otherwise(-1)
        state = seen.select(
            *KEY, "required", "facets", *(F.when(F.col("how").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in PROBE), F.when(F.col("how").isNotNull(), 1).otherwise(F.col("stage")).alias("stage"),
            F.col("_zero").alias("zero"), out_at.alias("out_at"), F.when(F.col("print").isNotNull(), F.array_append("prints", F.col("print"))).otherwise(F.col("prints")).alias("prints"),
        )
    else:
        ended.append(state.select("question", F.lit("rounds").alias("reason"), F.lit(rounds).alias("rounds")).distinct())
    cited = _cited(targets.select(*KEY, F.coalesce("facets", none).alias("facets")), pool, tells)
    known = pool.groupBy("question", "id").agg(F.max("score").alias("score"), F.min("turn").alias("turn"))
    evidence = known.join(cited, ["question", "id"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    evidence = ranked(evidence.select("question", "id", "score", "turn", "cited"), ["question"], [F.desc("cited"), F.desc("score"), F.col("id")], limit)
    if not log:
        log.append(state.sparkSession.createDataFrame([], f"question {state.schema['question'].dataType.simpleString()}, target string, round int, missing array<string>, how string, moves long, growth long"))
    return evidence, _all(ended), _all(log)


def _all(frames: list[DataFrame]) -> DataFrame | None:
    """The rows of a few written frames."""
    return reduce(DataFrame.unionByName, frames) if frames else None


def _told(pool: DataFrame, tells: DataFrame) -> DataFrame:
    """Which facets the nodes of each target tell; root has the nodes of all."""
    each = pool.select(*KEY, "id").unionByName(pool.select("question", F.lit("root").alias("target"), "id")).distinct()
    return each.join(tells, "id").groupBy(*KEY).agg(F.collect_set("facet").alias("told"))


def _open(at: DataFrame, pool: DataFrame, known: DataFrame, paths: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(question, target, source, action, direction, priority, turn, local): moves that targets can make and haven't."""
    each = at.select(*KEY).join(known.select("question", F.col("id").alias("source"), "turn"), "question")
    every = each.join(paths, "source")
    if tried is not None:
        every = every.join(tried, [*KEY, "source", "action", "direction"], "left_anti")
    own = pool.select(*KEY, F.col("id").alias("source"), F.lit(True).alias("own")).distinct()
    return every.join(own, [*KEY, "source"], "left").withColumn("local", F.coalesce("own", F.lit(False)) | (F.col("target") == "root")).drop("own")


def _cited(targets: DataFrame, pool: DataFrame, tells: DataFrame) -> DataFrame:
    """question, id and cited: of each target's facets the best node found for it that tells it."""
    every = pool.select(*KEY, "id", "score").unionByName(pool.select("question", F.lit("root").alias("target"), "id", "score")).groupBy(*KEY, "id").agg(F.max("score").alias("score"))
    wanted = targets.select(*KEY, F.explode(F.array_distinct("facets")).alias("facet"))
    return ranked(every.join(tells, "id").join(wanted, [*KEY, "facet"]), [*KEY, "facet"], [F.desc("score"), F.col("id")], 1, "n").select("question", "id", F.lit(True).alias("cited")).distinct()
