"""JSON lines: persona documents, dialogue files of several layouts, run logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators.windows import running


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One row a line, blank lines skipped. Strict: a line that can't be read ends the job; else it comes as nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, schemas.PERSONA)


def positions(personas: DataFrame, first: int, last: int) -> DataFrame:
    """Personas number first to last - 1, in order of their ids: files have no order that survives being split."""
    at = running(personas.select("ID").distinct(), [], ["ID"], F.lit(1), "n").where(F.col("n").between(first + 1, last))
    return personas.join(at.select("ID"), "ID", "left_semi")


def turn_order(key: Column) -> Column:
    """The number at the end of a key such as dialogue_turn_10; keys without one come last."""
    return F.coalesce(F.regexp_extract(key, r"_(\d+)$", 1).try_cast("long"), F.lit(1_000_000_000))


def sessions(personas: DataFrame) -> DataFrame:
    s = F.col("s")
    return personas.select(F.col("ID").alias("persona"), F.explode("Full_Session_Chain").alias("s")).select("persona", s["Session_ID"].alias("session"), s["Date"].alias("date"), s["Session_Type"].alias("kind"), F.coalesce(s["Event_Types"], F.array()).alias("event_types"), "s")


def turns(sessions_: DataFrame) -> DataFrame:
    """persona, session, turn, role, content; turns of a dialogue map in order of their keys' numbers."""
    keys = F.array_sort(F.transform(F.map_entries("s.Session_Dialogue"), lambda e: F.struct(turn_order(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("said"))))
    said = F.flatten(F.transform(keys, lambda e: e["said"]))
    return sessions_.select("persona", "session", F.posexplode(said).alias("turn", "t")).select("persona", "session", F.col("turn").cast("long").alias("turn"), "t.role", "t.content")


def session_questions(sessions_: DataFrame) -> DataFrame:
    """One row a question, with a key that is unique: persona, session, place."""
    return sessions_.select("persona", "session", F.posexplode("s.Session_Questions").alias("place", "q")).select("persona", "session", F.col("place").cast("long").alias("place"), "q.*")


def without_distractors(sessions_: DataFrame) -> DataFrame:
    """Sessions less what distracts, and how much was removed from each."""
    fields = ("Static_Conflict_Information", "Conditional_Conflict_Information", "Others_Dynamic_Information")
    out, gone = sessions_, F.lit(0)
    for f in fields:
        own = F.coalesce(F.col(f"s.{f}"), F.array().cast(sessions_.select(f"s.{f}").schema[0].dataType))
        kept = F.filter(own, lambda x: F.coalesce(F.trim(x["Role"]), F.lit("")) != "Distractor")
        out, gone = out.withColumn(f, kept), gone + F.size(own) - F.size(kept)
    return out.withColumn("removed", gone)


def triggers(sessions_: DataFrame) -> DataFrame:
    """What kinds of question a session calls for: a real change, a second static point, a conditional point."""
    changed = F.coalesce(F.exists("s.Updated_Attributes", lambda x: x["After"].isNotNull() & ~F.trim(x["After"]).isin("", "{}")), F.lit(False))
    static = F.coalesce(F.exists("s.Static_Conflict_Information", lambda x: x["Role"] == "Point_B"), F.lit(False))
    conditional = F.coalesce(F.exists("s.Conditional_Conflict_Information", lambda x: x["Role"].startswith("Point_")), F.lit(False))
    kinds = F.array_compact(F.array(F.when(changed, "dynamic_conflict"), F.when(static, "static_conflict"), F.when(conditional, "conditional_conflict")))
    return sessions_.select("persona", "session", kinds.alias("triggers"))


def dialogue_files(spark: SparkSession, path: str) -> DataFrame:
    """conversation, session, when, place, turn, speaker, role and text of dialogue files, whatever their layout.

    A file is a list of examples. Their turns are under conversation, conversations, dialogue or messages: a list of
    turns, or an object of session_N lists with session_N_date_time; or under sessions: a list of lists, or of objects
    with turns. A turn's text is its content, text or message, and what a picture shows; its number is turn_id, dia_id
    or its place from 1; its time its own or its session's. A turn that is a plain string is its text. Turns under
    turns, or examples that are turns themselves, are read by `flat_turns`.
    """
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("n", "e"))
    own = raw.select(F.coalesce(_of("e", "sample_id"), _of("e", "id"), F.col("n").cast("string")).alias("conversation"), F.coalesce(*(_of("e", k) for k in ("conversation", "conversations", "dialogue", "messages"))).alias("c"), _of("e", "sessions").alias("s"))
    listed = own.where(F.startswith("c", F.lit("["))).select("conversation", F.lit(0).cast("long").alias("session"), F.lit(None).cast("string").alias("when"), F.col("c").alias("turns"))
    keyed = own.where(F.startswith("c", F.lit("{"))).select("conversation", F.from_json("c", "map<string,string>").alias("m"))
    keyed = keyed.select("conversation", "m", F.explode("m").alias("key", "turns")).where(F.col("key").rlike(r"^session_\d+$") & F.startswith("turns", F.lit("[")))
    keyed = keyed.select("conversation", turn_order(F.col("key")).alias("session"), F.element_at("m", F.concat("key", F.lit("_date_time"))).alias("when"), "turns")
    nested = own.where(F.col("c").isNull()).select("conversation", F.posexplode(F.from_json("s", "array<string>")).alias("session", "x"))
    nested = nested.select("conversation", F.coalesce(_of("x", "session_id").try_cast("long"), F.col("session").cast("long")).alias("session"), _of("x", "timestamp").alias("when"), F.when(F.startswith("x", F.lit("[")), F.col("x")).otherwise(_of("x", "turns")).alias("turns"))
    return _said(listed.unionByName(keyed).unionByName(nested))


def flat_turns(spark: SparkSession, path: str) -> DataFrame:
    """As dialogue_files for one conversation a line: a list of turns or of sessions with turns, or an object that has one under turns, conversation or messages."""
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.coalesce(_of("value", "id"), F.monotonically_increasing_id().cast("string")).alias("conversation"), F.coalesce(*(_of("value", k) for k in ("turns", "conversation", "messages")), F.when(F.startswith("value", F.lit("[")), F.col("value")), F.concat(F.lit("["), F.col("value"), F.lit("]"))).alias("list"))
    parts = raw.select("conversation", F.posexplode(F.from_json("list", "array<string>")).alias("n", "x"))
    inner = parts.where(F.startswith(_of("x", "turns"), F.lit("["))).select("conversation", F.coalesce(_of("x", "session_id"), _of("x", "id")).try_cast("long").alias("named"), F.col("n").cast("long").alias("session"), F.coalesce(_of("x", "timestamp"), _of("x", "session_timestamp")).alias("when"), _of("x", "turns").alias("turns"))
    flat = parts.where(F.coalesce(~F.startswith(_of("x", "turns"), F.lit("[")), F.lit(True))).groupBy("conversation").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda p: p["x"])).alias("turns"))
    flat = flat.select("conversation", F.lit(0).cast("long").alias("session"), F.lit(None).cast("string").alias("when"), "turns")
    return _said(inner.select("conversation", F.coalesce("named", "session").alias("session"), "when", "turns").unionByName(flat))


def _of(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def _said(rows: DataFrame) -> DataFrame:
    """The turns of rows (conversation, session, when, turns: a JSON list of objects or strings)."""
    at = rows.select("conversation", "session", "when", F.posexplode(F.from_json("turns", "array<string>")).alias("place", "t"))
    whole = F.startswith(F.trim("t"), F.lit("{"))
    first = lambda *keys: F.coalesce(*(F.nullif(_of("t", k), F.lit("")) for k in keys))
    shown = lambda key, name: F.when(F.coalesce(_of("t", key), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.trim(_of("t", key))))
    text = F.when(whole, F.concat_ws(" ", F.trim(F.coalesce(first("content", "text", "message"), F.lit(""))), shown("blip_caption", "Image caption"), shown("query", "Image query"))).otherwise(F.col("t"))
    role = F.when(whole, F.coalesce(_of("t", "role"), _of("t", "speaker"), F.lit("unknown"))).otherwise("unknown")
    return at.select(
        "conversation", "session", F.when(whole, F.coalesce(_of("t", "timestamp"), _of("t", "time"), "when")).otherwise(F.col("when")).alias("when"), F.col("place").cast("long").alias("place"),
        F.when(whole, F.coalesce(_of("t", "turn_id"), _of("t", "dia_id"), (F.col("place") + 1).cast("string"))).otherwise((F.col("place") + 1).cast("string")).alias("turn"), F.when(whole, F.coalesce(_of("t", "speaker"), role)).otherwise("unknown").alias("speaker"), role.alias("role"), F.trim(text).alias("text"),
    )
