"""Dialogues from every participant's side.

For each participant of a conversation the dialogue is written once with that speaker as the
assistant and all others as named users; only the assistant's words are marked for the loss.
System turns stay system turns in every rendering and make no participant.

Turns are joined with their conversation's distinct speakers, so rows fan out by the number of
participants only.  A rendering is one text and so one row; a conversation too long for that can be
cut into runs of turn numbers, each of which begins with the system turns before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
UNNAMED = "unknown"
TAIL = "<|end|>\n"


def perspectives(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", length: int | None = None) -> DataFrame:
    """One row for each conversation and participant, or with ``length`` for each run of so many turn numbers.

    Returns ``conv_id``, ``perspective`` (the participant), ``part`` (0; with ``length`` the turn
    number / length, null for turns without a number), ``n_messages``, ``messages`` (array of role,
    name, content, loss), ``rendered`` and ``mask``: the assistant's contents in ``rendered`` as
    start and end code points, end exclusive.

    Messages stand by turn (null first), speaker, text; repeated turns are all kept.  A null speaker
    is a participant called ``unknown``, one with any that has this name; a null text is empty.  A
    null conversation is one like any other.  A conversation of system turns alone has no participant
    and gives no rows, nor does an empty table.  Speakers and texts are written as they are: what looks
    like a marker in them is no boundary, and the mask tells.  Other columns are not read.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    rows = rows.withColumn("part", F.floor(F.col("turn") / length).cast("long") if length else F.lit(0).cast("long"))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv_p"), F.col("speaker").alias("perspective")).distinct()
    if length:
        later = rows.select(F.col("conv_id").alias("conv_l"), F.col("part").alias("later")).distinct()
        before = rows.where(F.col("speaker") == SYSTEM).join(later, F.col("conv_id").eqNullSafe(F.col("conv_l")) & (F.col("later") > F.coalesce("part", F.lit(-1))))
        rows = rows.unionByName(before.select("conv_id", "turn", "speaker", "content", F.col("later").alias("part")))
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("conv_p"))).drop("conv_p")

    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" "), name), F.lit("")), F.lit("|>\n"))
    order = Window.partitionBy("conv_id", "perspective", "part").orderBy("turn", "speaker", "content")
    upto = F.sum(F.char_length("head") + F.char_length("content") + len(TAIL)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = seen.select("*", head.alias("head"), F.struct(role.alias("role"), name.alias("name"), F.col("content").alias("content"), own.alias("loss")).alias("message"))
    placed = placed.withColumn("n", F.row_number().over(order)).withColumn("end", (upto - len(TAIL)).cast("int"))
    said = F.array_sort(F.collect_list(F.struct("n", "head", "message", "end")))
    grouped = placed.groupBy("conv_id", "perspective", "part").agg(F.count("*").alias("n_messages"), said.alias("said"))
    rendered = F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["message"]["content"], F.lit(TAIL))), "")
    mask = F.transform(F.filter("said", lambda s: s["message"]["loss"]), lambda s: F.struct((s["end"] - F.char_length(s["message"]["content"])).alias("start"), s["end"].alias("end")))
    return grouped.select("conv_id", "perspective", "part", "n_messages", F.transform("said", lambda s: s["message"]).alias("messages"), rendered.alias("rendered"), mask.alias("mask"))
