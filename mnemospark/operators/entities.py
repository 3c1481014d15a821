"""Who and what is meant: aliases against a registry of entities, topics against chains, evidence ids as models misspell them; what extraction may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions.shared import stored

from .answers import similarity_column
from .graph import merged
from .pairs import spelt_alike
from .search import ranked

#: Relations that an extraction may state between events.
RELATIONS = ("CAUSES", "CONTRIBUTES_TO", "ENABLES", "CONTEXT_FOR", "FOLLOW_UP_OF", "SAME_EVENT", "PART_OF")


def exact(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """alias, type and id of mentions (alias, type) that an entity of the registry (id, type, place, aliases) is called, whatever
    the case; of several entities with one alias the last in the registry is meant."""
    named = registry.select("type", "place", "id", F.explode("aliases").alias("a")).groupBy("type", F.lower(F.trim("a")).alias("key")).agg(F.max_by("id", F.struct("place", "id")).alias("id"))
    return mentions.select("alias", "type").distinct().withColumn("key", F.lower(F.trim("alias"))).join(named, ["type", "key"]).select("alias", "type", "id")


def nearest_of_type(mentions: DataFrame, registry: DataFrame, most: int = 10_000) -> DataFrame:
    """alias, type, id and like: the entity (id, type, v) of a mention's type (alias, type, v) with the highest cosine, ties to the
    smaller id. Mentions are those of new windows; they are broadcast in blocks of about `most`, and the registry streams by."""
    asked = mentions.select("alias", "type", F.col("v").alias("mv"))
    parts, found = 1 + asked.count() // most, None
    for i in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("alias", "type"), F.lit(parts)) == i)
        met = registry.select("id", "type", "v").join(F.broadcast(some), "type")
        own = ranked(met.select("alias", "type", "id", F.round(C.cosine(F.col("mv"), F.col("v")), 6).alias("like")), ["alias", "type"], [F.desc("like"), F.col("id")], 1)
        found = own if found is None else found.unionByName(own)
    return found.drop("rank")


def canonical(mentions: DataFrame, registry: DataFrame, space: str, high: float = 0.85, low: float = 0.75, spelt: float = 0.85, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Whom mentions (alias, type, v) mean: (alias, type, id, how), and what a judge should look at: (alias, type, id, like).

    An entity with that alias is meant (exact). Else the most alike of its type is, from `high` on (alike). Between `low`
    and that, if it is also spelt like one of its aliases, a judge decides: verdicts (alias, type, same) say what one has;
    what none says, and all others, are new entities with a stable id of their alias (judged, new). Where an alias is exact
    and another entity is alike from `high` on, the two are one: such pairs merge, transitively, into the smaller id.
    """
    told, near = exact(mentions, registry), nearest_of_type(mentions, registry)
    names = registry.select(F.col("id").alias("i"), "aliases")
    at = mentions.select("alias", "type").distinct().join(told.withColumnRenamed("id", "named"), ["alias", "type"], "left").join(near, ["alias", "type"], "left")
    # the second best may be meant where the best is the entity itself: an exact one merges with another only
    doubtful = at.where((F.col("named").isNull()) & (F.col("like") < high) & (F.col("like") >= low)).join(names, F.col("id") == F.col("i"))
    spelling = doubtful.select("alias", "type", "id", "like", F.explode("aliases").alias("other"))
    unsure = spelling.withColumn("ratio", similarity_column(C.collapsed(F.col("alias")), C.collapsed(F.col("other")))).groupBy("alias", "type", "id", "like").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= spelt).drop("ratio")
    judged = unsure.join(verdicts, ["alias", "type"], "left").select("alias", "type", F.coalesce("same", F.lit(False)).alias("same")) if verdicts is not None else unsure.select("alias", "type", F.lit(False).alias("same"))
    fresh = C.stable_id("entity", F.lit(space), F.col("type"), C.collapsed(F.col("alias")))
    known = at.join(judged, ["alias", "type"], "left")
    alike = F.coalesce(F.col("like") >= high, F.lit(False))
    meant = F.when(F.col("named").isNotNull(), F.col("named").cast("string")).when(alike | F.coalesce("same", F.lit(False)), F.col("id").cast("string")).otherwise(fresh)
    how = F.when(F.col("named").isNotNull(), "exact").when(alike, "alike").when(F.col("same"), "judged").otherwise("new")
    pairs = at.where(F.col("named").isNotNull() & alike & (F.col("named") != F.col("id"))).select(F.col("named").cast("string").alias("a"), F.col("id").cast("string").alias("b")).distinct()
    out = known.select("alias", "type", meant.alias("id"), how.alias("how"))
    if pairs.limit(1).count():
        out = out.join(merged(pairs), "id", "left").select("alias", "type", F.coalesce("canonical", "id").alias("id"), "how")
    return out, unsure


def routed(events: DataFrame, chains: DataFrame, first: int = 8, least: float = 0.55) -> DataFrame:
    """scope, id, topic and how: the chain that each event (scope, id, topic, aliases, v) belongs to.

    chains: scope, place, topic, names, v. A chain that the event's topic or one of its aliases names is meant, the first
    one of several; else the most alike of the scope's first `first` chains, from `least` on; else a chain of its own topic.
    """
    asked = events.select("scope", "id", F.explode(F.array_distinct(F.concat(F.array("topic"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("a")).select("scope", "id", F.lower(F.trim("a")).alias("key"))
    called = chains.select("scope", "place", F.col("topic").alias("named"), F.explode(F.concat(F.array("topic"), "names")).alias("a")).select("scope", "place", "named", F.lower(F.trim("a")).alias("key")).distinct()
    by_name = asked.join(called, ["scope", "key"]).groupBy("scope", "id").agg(F.min_by("named", F.struct("place", "named")).alias("named"))
    few = ranked(chains.select("scope", "place", F.col("topic").alias("near"), F.col("v").alias("cv")), ["scope"], [F.col("place"), F.col("near")], first, "n").drop("n")
    alike = events.join(by_name, ["scope", "id"], "left_anti").join(few, "scope").select("scope", "id", "near", "place", F.round(C.cosine(F.col("v"), F.col("cv")), 6).alias("like"))
    best = ranked(alike, ["scope", "id"], [F.desc("like"), F.col("place"), F.col("near")], 1, "n").where(F.col("like") >= least).select("scope", "id", "near")
    at = events.select("scope", "id", "topic").join(by_name, ["scope", "id"], "left").join(best, ["scope", "id"], "left")
    own = F.regexp_replace(F.regexp_replace(F.lower(F.trim("topic")), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    how = F.when(F.col("named").isNotNull(), "named").when(F.col("near").isNotNull(), "alike").otherwise("new")
    return at.select("scope", "id", F.coalesce("named", "near", own).alias("topic"), how.alias("how"))


def normalised_relations(relations: DataFrame, events: DataFrame) -> DataFrame:
    """Relations (window, place, source, target, type, confidence) between two different events (window, ref) of their window,
    one for each directed pair: the surest, the first of equals. A confidence that is missing is 1."""
    refs = events.select("window", "ref").distinct()
    good = relations.where("source <> target").join(refs.withColumnRenamed("ref", "source"), ["window", "source"], "left_semi").join(refs.withColumnRenamed("ref", "target"), ["window", "target"], "left_semi")
    best = F.row_number().over(Window.partitionBy("window", "source", "target").orderBy(F.desc(F.coalesce("confidence", F.lit(1.0))), "place"))
    return good.withColumn("n", best).where("n = 1").select("window", "source", "target", F.upper("type").alias("type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def extraction_errors(events: DataFrame, relations: DataFrame, claims: DataFrame) -> DataFrame:
    """window, error and n: what makes an extraction invalid. events: window, ref, title, summary; relations as above; claims:
    window, subject, dimension, aspect, value."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    refs = events.groupBy("window", "ref").agg(F.count("*").alias("n"))
    parts = [
        events.where(empty("ref")).select("window", F.lit("event without a ref").alias("error")),
        refs.where("n > 1 AND trim(coalesce(ref, '')) <> ''").select("window", F.lit("ref used twice").alias("error")),
        events.where(empty("title") & empty("summary")).select("window", F.lit("event without title and summary").alias("error")),
        claims.where(empty("subject") | empty("dimension") | empty("aspect") | F.col("value").isNull()).select("window", F.lit("incomplete claim").alias("error")),
        relations.where(F.col("source") == F.col("target")).select("window", F.lit("relation to itself").alias("error")),
        relations.where(~F.upper("type").isin(*RELATIONS)).select("window", F.lit("unknown relation").alias("error")),
        relations.where(~F.coalesce("confidence", F.lit(1.0)).between(0.0, 1.0)).select("window", F.lit("confidence out of range").alias("error")),
    ]
    known = refs.select("window", "ref")
    for end in ("source", "target"):
        parts.append(relations.join(known.withColumnRenamed("ref", end), ["window", end], "left_anti").select("window", F.lit(f"unknown {end}").alias("error")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("window", "error").agg(F.count("*").alias("n"))


def repaired_ids(said: DataFrame, valid: DataFrame, like: float = 0.92, margin: float = 0.04) -> DataFrame:
    """scope, value, id and how: which evidence a model meant by `value` (said: scope, value) among its scope's ids (valid:
    scope, id): that id itself, else the only one with the same letters and digits, else the most alike from `like` on if
    the next is `margin` less alike; else none. Values are compared with the ids of their own scope alone."""
    key = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]", "")
    at = said.select("scope", F.trim("value").alias("value")).distinct()
    own = stored(valid.select("scope", "id").distinct().withColumn("k", key("id")))
    keys = own.groupBy("scope", "k").agg(F.count("*").alias("n"), F.min("id").alias("normal")).where("n = 1").drop("n")
    written = own.select("scope", F.col("id").alias("value"), F.lit(True).alias("same"))
    told = stored(at.join(written, ["scope", "value"], "left").withColumn("k", key("value")).join(keys, ["scope", "k"], "left").select("scope", "value", F.when(F.col("same"), F.col("value")).otherwise(F.col("normal")).alias("id"), F.when(F.col("same"), "exact").when(F.col("normal").isNotNull(), "normalized").alias("how")))
    left = told.where("how IS NULL").select("scope", "value")
    # what is less alike than like - margin neither is meant nor stands in the way
    scored = spelt_alike(left.withColumnRenamed("value", "a"), own.select("scope", F.col("id").alias("b")), ["scope"], like - margin).withColumnsRenamed({"a": "value", "b": "id"})
    two = ranked(scored, ["scope", "value"], [F.desc("ratio"), F.desc("id")], 2).groupBy("scope", "value").agg(F.max(F.struct("ratio", "id")).alias("best"), F.when(F.count("*") > 1, F.min("ratio")).alias("next"))
    close = two.where((F.col("best.ratio") >= like) & (F.col("next").isNull() | (F.col("best.ratio") - F.col("next") >= margin))).select("scope", "value", F.col("best.id").alias("id"), F.lit("close").alias("how"))
    rest = left.join(close, ["scope", "value"], "left").select("scope", "value", "id", F.coalesce("how", F.lit("none")).alias("how"))
    return told.where("how IS NOT NULL").unionByName(rest)


def _disjoint() -> Column:
    """Whether two candidates' times (starts, ends and p_starts, p_ends) are both known and don't meet."""
    end, p_end = F.coalesce("ends", "starts"), F.coalesce("p_ends", "p_starts")
    return F.coalesce((end < F.col("p_starts")) | (p_end < F.col("starts")), F.lit(False))


def near_duplicate_penalties(candidates: DataFrame, like: float = 0.92, most: float = 0.08) -> DataFrame:
    """probe, id, score and penalty: what each of a probe's few candidates (probe, id, score, v, sources, entities, starts, ends)
    loses for its likeness to a better one, if their times don't exclude each other and they share a source, or an entity
    at times that are both known."""
    ordered = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id")))
    better = ordered.select("probe", *(F.col(c).alias(f"p_{c}") for c in ("rank", "v", "sources", "entities", "starts", "ends")))
    met = ordered.join(better, "probe").where(F.col("p_rank") < F.col("rank"))
    known = F.col("starts").isNotNull() & F.col("p_starts").isNotNull()
    alike = F.arrays_overlap("sources", "p_sources") | (F.arrays_overlap("entities", "p_entities") & known)
    cos = F.round(C.cosine(F.col("v"), F.col("p_v")), 6)
    cost = met.where(F.coalesce(alike, F.lit(False)) & ~_disjoint()).select("probe", "id", cos.alias("c")).where(F.col("c") >= like).groupBy("probe", "id").agg(F.least(F.lit(most), F.max("c") - like).alias("penalty"))
    return ordered.select("probe", "id", "score").join(cost, ["probe", "id"], "left").na.fill(0.0, ["penalty"])
