"""Multi-party chat formatting: every speaker's view of a whole dialogue, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, stored

OPEN, CLOSE = "<|", "|>"
END = f"{OPEN}end{CLOSE}\n"


def perspectives(turns: DataFrame) -> DataFrame:
    """The messages of every dialogue as each of its speakers sees them: that one as assistant, the others as named users.

    turns has conv_id, turn, role and text; a speaker is a role other than "system". Each speaker of a dialogue views
    all of it, one row a message: conv_id, speaker, place (0, 1 ... in the dialogue), role, name (of a user), text (the
    message as rendered), start and length (in characters, of its content and end within the speaker's whole rendering)
    and train (the speaker's own). A rendering is its texts in order of place; its mask is the spans that train.
    A message is OPEN role CLOSE, or OPEN user:name CLOSE for other speakers, a newline, its content and END. OPEN
    within a content or name gets a space after its "<", so no turn can forge a mark.

    Nothing is cut and nothing is gathered into a row: turns are dealt out by range of their order, places and offsets
    are sums within a range added to sums over the ranges before, so neither a dialogue, however long, nor one turn
    number lands in one task. `dialogues` makes single texts of them.

    Turns are in order of turn, role, text, so ties and repeated rows, which all stay, have one order; what turns are
    numbered doesn't matter otherwise. A null turn goes before all others, a null role is the speaker "unknown", a null
    text is empty; rows with a null conv_id form a dialogue of their own. Dialogues of system turns alone have no
    speaker, so no row; an empty table gives none. Other columns are ignored.
    """
    told = _told(turns).withColumn("tie", F.monotonically_increasing_id())
    dealt = stored(told.repartitionByRange("conv_id", "turn", "who", "said", "tie").withColumn("part", F.spark_partition_id()))
    per = dealt.groupBy("conv_id", "part", "who").agg(F.count("*").alias("n"), F.sum(F.length(_head("user", "who")) + F.length(_body("said"))).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("conv_id", "part").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.coalesce(F.sum(F.when(F.col("who") == "system", F.col("n"))), F.lit(0)).alias("rules"))
    starts = parts.select("conv_id", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "size", "rules")))
    speakers = per.where("who <> 'system'").select("conv_id", F.col("who").alias("speaker")).distinct()
    seats = starts.alias("s").join(speakers.alias("k"), F.col("s.conv_id").eqNullSafe(F.col("k.conv_id"))).select("s.*", "speaker")
    own = per.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("who").alias("w"), F.col("n").alias("own"))
    seats = seats.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("speaker") == F.col("w")), "left").drop("c", "p", "w")
    seats = seats.withColumn("own_before", F.coalesce(F.sum("own").over(Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seats = seats.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "speaker", "n_before", "size_before", "rules_before", "own_before")
    views = dealt.join(seats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    mine = F.col("who") == F.col("speaker")
    kind = F.when(mine, "assistant").when(F.col("who") == "system", "system").otherwise("user")
    head, body = F.when(mine, _head("assistant")).when(F.col("who") == "system", _head("system")).otherwise(_head("user", "who")), _body("said")
    order = Window.partitionBy("conv_id", "part", "speaker").orderBy("turn", "who", "said", "tie")
    # sums of ranges before count every head as a user's; the speaker's own and the system's differ by a fixed length
    shift = lambda role, who: F.length(_head(role)) - F.length(_head("user", who))
    base = F.col("size_before") + F.col("own_before") * shift("assistant", "speaker") + F.col("rules_before") * F.lit(len(_text("system")) - len(_text("user", "system")))
    inside = F.coalesce(F.sum(F.length(head) + F.length(body)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return views.select(
        "conv_id", "speaker", (F.col("n_before") + F.row_number().over(order) - 1).cast("long").alias("place"), kind.alias("role"), F.when(kind == "user", F.col("who")).alias("name"),
        F.concat(head, body).alias("text"), (base + inside + F.length(head)).cast("long").alias("start"), F.length(body).cast("long").alias("length"), mine.alias("train"),
    )


def dialogues(messages: DataFrame) -> DataFrame:
    """Single texts of what perspectives gives: conv_id, speaker, n_messages, n_trained, text and mask (start and length
    of each trained span). A speaker's whole rendering is one row here, so it is for dialogues that fit one."""
    own = F.sort_array(F.collect_list(F.struct("place", "text", "start", "length", "train")))
    at = messages.groupBy("conv_id", "speaker").agg(F.count("*").alias("n_messages"), F.count_if("train").alias("n_trained"), own.alias("m"))
    mask = F.transform(F.filter("m", lambda m: m["train"]), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length")))
    return at.select("conv_id", "speaker", "n_messages", "n_trained", F.array_join(F.transform("m", lambda m: m["text"]), "").alias("text"), mask.alias("mask"))


def _text(role: str, name: str | None = None) -> str:
    return f"{OPEN}{role}{':' + name if name else ''}{CLOSE}\n"


def _head(role: str, name: str | None = None):
    return F.concat(F.lit(f"{OPEN}{role}:"), F.col(name), F.lit(f"{CLOSE}\n")) if name else F.lit(_text(role))


def _body(said: str):
    return F.concat(F.col(said), F.lit(END))


def _told(turns: DataFrame) -> DataFrame:
    turns, _ = carried(turns, ["conv_id", "turn", "role", "text"], keep=[])
    role = F.coalesce(F.lower(F.trim(F.col("role").cast("string"))), F.lit("unknown"))
    safe = lambda c: F.replace(c, F.lit(OPEN), F.lit("< |"))
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        safe(F.when(role == "", "unknown").otherwise(role)).alias("who"),
        safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("said"),
    )
