"""Conversations in reply order, with quotations linked to what they quote and taken out.

Only DataFrame functions. Quoted lines begin with ``>`` signs, as many as the
quote is deep. A quote's lines of one depth in a row are a passage; passages
and the messages' own lines are split into sentences, normalised and hashed.
A quoted sentence comes from the first message of the conversation that says
it itself; a passage comes from the message that most of its sentences come
from; a message replies to the source of its least deep passage. Following
these links upwards gives each message its thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: What a quoted line begins with, and the line that may come before a quote.
PREFIX = r"^(?:[\x20\t]*>)+"
WROTE = r"(?i)(?:wrote|writes|schrieb|a écrit|écrit|escribió)[\x20\t]*:[\x20\t\r]*$"


def depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them; null stays null."""
    lines = F.split(text, "\n", -1)
    own = F.filter(lines, lambda line, i: (depth(line) == 0) & ~(line.rlike(WROTE) & (i + 1 < F.size(lines)) & (depth(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)))
    return F.when(F.contains(text, F.lit(">")), F.btrim(F.array_join(own, "\n"), F.lit(" \t\n\x0b\f\r"))).otherwise(text)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def sentences(text: Column) -> Column:
    """Hashes of the distinct sentences of a text, normalised; those without a letter or digit count as none."""
    parts = F.filter(F.split(normal(text), r"(?<=[.!?])[\x20]"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    return F.array_distinct(F.transform(parts, lambda s: F.xxhash64(s)))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, depth, text) of quoted passages: lines of one depth in a row. A message's lines are as many as its text has."""
    quoting = messages.where(F.contains("text", F.lit(">"))).select("conv_id", "turn", "text").distinct().select("conv_id", "turn", F.xxhash64("text").alias("m"), F.split("text", "\n", -1).alias("lines"))
    lines = quoting.select("conv_id", "turn", "m", F.posexplode("lines").alias("i", "line")).withColumn("depth", depth(F.col("line")))
    message = Window.partitionBy("conv_id", "turn", "m").orderBy("i")
    runs = lines.withColumn("new", (F.lag("depth", 1, -1).over(message) != F.col("depth")).cast("int")).withColumn("passage", F.sum("new").over(message))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.regexp_replace("line", PREFIX, "").alias("line")))), lambda x: x["line"]), "\n")
    return runs.where("depth > 0").groupBy("conv_id", "turn", "m", "passage", "depth").agg(text.alias("text"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, linked_passages): whom each quoting message replies to.

    Of sources with as many sentences the later counts; sources are earlier
    turns of the same conversation. First sayings are aggregated before they
    are joined, so that a sentence that everyone says is one row.
    """
    quoted = passages(messages).select("conv_id", "turn", "m", "passage", "depth", F.explode(sentences(F.col("text"))).alias("h"))
    there = quoted.select("conv_id").distinct()
    said = messages.join(there, "conv_id", "left_semi").select("conv_id", "turn", F.explode(sentences(own_text(F.col("text")))).alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    votes = quoted.join(said, ["conv_id", "h"]).where("source < turn").groupBy("conv_id", "turn", "m", "passage", "depth", "source").agg(F.count("*").alias("votes"))
    of_passage = votes.groupBy("conv_id", "turn", "m", "passage", "depth").agg(F.max(F.struct("votes", "source")).alias("best"))
    return of_passage.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("near"), "best.votes", "best.source")).getField("source").alias("parent"), F.count("*").alias("linked_passages"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root, level): the upmost message and the number of replies up to it.

    Each round doubles how far links reach; parents are earlier, so it ends.
    """
    now = cut(links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("level")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("level").alias("more"))
        joined = cut(now.join(up, ["conv_id", "root"], "left"))
        now = joined.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        if joined.where("next IS NOT NULL").isEmpty():
            return now


def reply_ordered(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, root_turn, level, linked_passages), ordered by conversation, thread and turn.

    ``text`` has no quotes. A message that quotes nothing known begins a thread
    of its own, so that a conversation without quotes stays in its order; a
    reply always follows what it replies to. A null text stays null; rows
    without a conversation or turn are kept, unlinked; rows that repeat a
    conversation and turn share its link. Other columns are not read.
    """
    m = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    links = cut(reply_links(m))
    linked = links.join(threads(links), ["conv_id", "turn"])
    out = m.join(linked, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", own_text(F.col("text")).alias("text"), F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"), F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("linked_passages", F.lit(0)).cast("long").alias("linked_passages"),
    ).orderBy("conv_id", "root_turn", "turn", "role", "text")
