"""Records of runs: event types of sessions, clean questions, flattened and nested results, acceptance, fresh probes, memos."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C

from .evaluation import KINDS

#: What a session is about, by what is told in it at first, by what changes in it, or else.
FIRST_TOLD = {
    "Residence": "Talking_About_Current_Residence", "Work_Status": "Talking_About_Current_Work_Rhythm", "Career_Status": "Talking_About_Current_Career", "Health_Status": "Talking_About_Current_Health",
    "Social_Status": "Talking_About_Recent_Social_Life", "Marital_Status": "Talking_About_Current_Relationship", "Children_Status": "Talking_About_Current_Family_Life",
}
CHANGED = {
    "Residence": "Relocation_Update", "Work_Status": "Workload_Change_Update", "Career_Status": "Career_Change_Update", "Health_Status": "Health_Condition_Update",
    "Social_Status": "Social_Life_Change_Update", "Marital_Status": "Relationship_Status_Change", "Children_Status": "Family_Expansion_Update",
}
SMALL_TALK = (
    "Casual_Catch_Up", "Sharing_a_Small_Daily_Story", "Talking_About_Food_and_Mood", "Weekend_Plan_Chat", "Weather_and_Daily_Life_Chat", "Remembering_an_Old_Experience", "Talking_About_a_Hobby",
    "Light_Complaint_or_Funny_Incident", "Reflecting_on_Life_Lately", "Talking_About_a_Recent_Show_or_Movie",
)
#: What a question may be said to test, and how hard it may be.
ABILITIES, DIFFICULTIES = ("track_state_over_time", "detect_conflict", "recover_truth", "bind_condition"), ("easy", "medium", "hard")
MOST_RETRIEVED = 32


def event_types(kind: Column, attributes: Column, draw: Column) -> Column:
    """The event types of a session by its kind and the attributes (array) told or changed in it, each once; small talk is one of
    ten kinds by the draw (0 to 1)."""
    table = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    found = lambda names: F.array_distinct(F.array_compact(F.transform(F.coalesce(attributes, F.array().cast("array<string>")), lambda a: F.try_element_at(table(names), a))))
    one = lambda name: F.array(F.lit(name))
    told, changed = found(FIRST_TOLD), found(CHANGED)
    talk = F.array(F.element_at(F.array(*map(F.lit, SMALL_TALK)), (F.floor(draw * len(SMALL_TALK)) % len(SMALL_TALK) + 1).cast("int")))
    return (
        F.when(kind == "initial_reveal", F.when(F.size(told) > 0, told).otherwise(one("Initial_Life_Update")))
        .when(kind == "update", F.when(F.size(changed) > 0, changed).otherwise(one("General_Life_Update")))
        .when(kind == "chitchat", talk).when(kind == "future_plan", one("Future_Planning_Conversation")).otherwise(one("General_Conversation"))
    )


def sanitised(questions: DataFrame) -> DataFrame:
    """Questions (session, place, question_id, question, answer, conflict_type, ability, difficulty) that ask and answer something;
    what is unknown or missing in their other fields takes the usual value, a missing id is Q_ and the place."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    among = lambda c, known, usual: F.when(text(c).isin(*known), text(c)).otherwise(usual)
    good = questions.where((text("question") != "") & (text("answer") != ""))
    return good.select(
        "session", F.coalesce(F.nullif(text("question_id"), F.lit("")), F.format_string("Q_%03d", F.col("place"))).alias("question_id"), text("question").alias("question"), text("answer").alias("answer"),
        among("conflict_type", KINDS, "dynamic_conflict").alias("conflict_type"), among("ability", ABILITIES, "recover_truth").alias("ability"), among("difficulty", DIFFICULTIES, "medium").alias("difficulty"),
    )


def rewritten(questions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Questions (session, question_id, question, answer) with their rewrites (session, question_id, text) where those hold: they
    ask something else than before in other words, and don't give the answer away. Columns rewritten and reason tell."""
    at = questions.join(rewrites.groupBy("session", "question_id").agg(F.max("text").alias("text")), ["session", "question_id"], "left")
    new, answer = F.trim(F.coalesce("text", F.lit(""))), C.answer_text(F.col("answer"))
    reason = F.when(new == "", "empty").when(C.answer_text(new) == C.answer_text(F.col("question")), "unchanged").when((F.length(answer) > 3) & F.contains(C.answer_text(new), answer), "answer given away")
    return at.select("session", "question_id", F.when(reason.isNull(), new).otherwise(F.col("question")).alias("question"), "answer", reason.isNull().alias("rewritten"), reason.alias("reason"))


def pruned(record: Column, fields: list[str]) -> Column:
    """The record (a struct) with these fields only, in this order."""
    return F.struct(*(record[f].alias(f) for f in fields))


def judge_rows(personas: DataFrame) -> DataFrame:
    """persona, session, place and the fields of each question of personas (persona, sessions: array of session, questions)."""
    at = personas.select("persona", F.explode("sessions").alias("s"))
    return at.select("persona", F.col("s.session").alias("session"), F.posexplode("s.questions").alias("place", "q")).select("persona", "session", "place", "q.*")


def persona_records(scored: DataFrame) -> DataFrame:
    """persona, questions, accuracy and sessions: each persona's scored questions (persona, session, question_id, accuracy)
    nested by session, with means of both. A persona's own results are one row."""
    inner = scored.groupBy("persona", "session").agg(F.sort_array(F.collect_list(F.struct("question_id", "accuracy"))).alias("questions"), F.round(F.avg("accuracy"), 6).alias("accuracy"))
    return inner.groupBy("persona").agg(F.sum(F.size("questions")).alias("questions"), F.sort_array(F.collect_list(F.struct("session", "accuracy", "questions"))).alias("sessions"))


def acceptance(expected: DataFrame, predictions: DataFrame, traces: DataFrame) -> DataFrame:
    """problem and n: why a full run is not accepted; no rows if it is. expected: example, qa; predictions: example, qa;
    traces: example, qa, retrieved. Each must have every expected row once and no other, and no trace more than MOST_RETRIEVED."""
    key = ["example", "qa"]
    every = None
    for name, df in (("predictions", predictions), ("traces", traces)):
        own = df.select(*key)
        for problem, found in (
            (f"{name} missing", expected.select(*key).join(own, key, "left_anti")),
            (f"{name} not asked for", own.join(expected.select(*key), key, "left_anti")),
            (f"{name} repeated", own.groupBy(*key).count().where("count > 1").select(*key)),
        ):
            rows = found.select(F.lit(problem).alias("problem"))
            every = rows if every is None else every.unionByName(rows)
    every = every.unionByName(traces.where(F.col("retrieved") > MOST_RETRIEVED).select(F.lit("too much retrieved").alias("problem")))
    return every.groupBy("problem").agg(F.count("*").alias("n"))


def fingerprint(query: Column, must: Column, entities: Column, starts: Column, ends: Column) -> Column:
    """What a probe asks for, whatever the order and case of its terms."""
    flat = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))), ",")
    return F.sha2(F.concat_ws("|", C.collapsed(F.coalesce(query, F.lit(""))), flat(must), flat(entities), F.coalesce(starts, F.lit("")), F.coalesce(ends, F.lit(""))), 256)


def fresh_probes(proposed: DataFrame, tried: DataFrame) -> DataFrame:
    """Probes (target, query, must, should, entities, starts, ends, hard) that weren't tried, with how.

    A probe whose fingerprint (tried: target, print) is new goes as it is. One that was tried is relaxed once: of its must
    terms the first stays, the others become should terms, and its time is no longer hard; if that was tried too, or
    nothing can be relaxed, the target has none.
    """
    prints = lambda df: df.withColumn("print", fingerprint(F.col("query"), F.col("must"), F.col("entities"), F.col("starts"), F.col("ends")))
    seen, first = tried.select("target", "print").distinct(), prints(proposed)
    new = first.join(seen, ["target", "print"], "left_anti").withColumn("how", F.lit("new"))
    old = first.join(seen, ["target", "print"], "left_semi").where((F.size("must") > 1) | F.col("hard"))
    eased = old.select("target", "query", F.slice("must", 1, 1).alias("must"), F.array_distinct(F.concat("should", F.expr("slice(must, 2, greatest(size(must), 1))"))).alias("should"), "entities", "starts", "ends", F.lit(False).alias("hard"))
    eased = prints(eased).join(seen, ["target", "print"], "left_anti").withColumn("how", F.lit("relaxed"))
    return new.unionByName(eased)


def slimmed(facts: DataFrame, questions: DataFrame, most: int = 8) -> DataFrame:
    """probe, id, key, value and rank: of each node's facts (probe, id, key, value, cited) those that bear on the question
    (questions: probe, text): cited ones first, then by the share of the question's words they have; without any, the first."""
    asked = questions.select("probe", F.array_distinct(C.tokens(F.col("text"))).alias("q"))
    said = facts.join(asked, "probe").withColumn("like", C.overlap_share(F.col("q"), C.tokens(F.concat_ws(" ", F.translate("key", "_", " "), "value"))))
    order = Window.partitionBy("probe", "id").orderBy(F.desc("cited"), F.desc("like"), "key", "value")
    rank = F.row_number().over(order)
    return said.withColumn("rank", rank.cast("long")).where((F.col("rank") <= most) & (F.col("cited") | (F.col("like") > 0) | (F.col("rank") == 1))).select("probe", "id", "key", "value", "rank")


def memoised(asked: DataFrame, key: list[str], memo: DataFrame | None, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, new): results of all that is asked, computed once for each key: from the memo where it has the key, else by
    compute, which gives key columns and results; new are its rows, to be appended to the memo."""
    todo = asked.select(*key).distinct()
    new = compute(todo if memo is None else todo.join(memo.select(*key), key, "left_anti"))
    return asked.join(new if memo is None else memo.unionByName(new), key, "left"), new


def run_summary(log: DataFrame) -> DataFrame:
    """stage, calls, failed, seconds, tokens and cost of a run's log (stage, seconds, tokens, cost, ok), and all stages together (null)."""
    sums = (F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return log.rollup("stage").agg(*sums)
