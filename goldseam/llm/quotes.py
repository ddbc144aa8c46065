r"""Quotation linking: who replies to whom, found from the passages that messages quote.

A line's quote level is the number of ``>`` that it begins with (``>> a`` and ``> > a`` are level 2). A
passage is a run of lines of one level in a message; it and its single lines are hashed after white
space is collapsed and letters are lowered, so re-wrapped quotations still match. The original of a quoted passage
is the first message of the conversation that says it in its own words (level 0), if that is an earlier
one. A message replies to the message that most of its quoted words come from, at its lowest level
with a link; at equal words to the later one. Threads are followed to their first message, and a
conversation is ordered by thread, then by turn, so every message stands behind what it replies to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import blocked_running_sum, staged

_MARKS = r"^(?:[ \t]{0,3}>)+"
_SPACES = r"[ \t\n\x0B\f\r]+"
#: Messages of one part of a formatted conversation.
PART = 256


def _parsed(messages: DataFrame) -> DataFrame:
    """(place, conv_id, turn, at, role, lines, bodies, starts): lines of a message with their quote level."""

    def level(line):
        return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))

    split = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = messages.select(
        F.monotonically_increasing_id().alias("place"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("at"),
        "role",
        split.alias("raw"),
    ).withColumns(
        {
            "levels": F.transform("raw", level),
            "bodies": F.transform("raw", lambda x: F.regexp_replace(x, _MARKS + r"[ \t]?", "")),
        }
    )
    starts = "filter(sequence(0, size(levels) - 1), i -> i = 0 OR levels[i] != levels[i - 1])"
    return lines.withColumn("starts", F.expr(starts)).drop("raw")


def _units(parsed: DataFrame) -> DataFrame:
    """(place, conv_id, at, level, k1, k2, words) of every different passage and line of a message."""
    runs = (
        "transform(starts, (s, j) -> struct(levels[s] AS level, array_join(slice(bodies, s + 1,"
        " if(j + 1 < size(starts), starts[least(j + 1, size(starts) - 1)], size(levels)) - s), ' ') AS body))"
    )
    lines = "transform(bodies, (b, i) -> struct(levels[i] AS level, b AS body))"
    units = parsed.select(
        "place", "conv_id", "at", F.explode(F.expr(f"concat({runs}, {lines})")).alias("u")
    ).select(
        "place", "conv_id", "at", "u.level",
        F.lower(F.trim(F.regexp_replace("u.body", _SPACES, " "))).alias("norm"),
    )
    return (
        units.where("norm != ''")
        .select(
            "place", "conv_id", "at", "level",
            F.xxhash64(F.lit(11), "norm").alias("k1"),
            F.xxhash64(F.lit(12), "norm").alias("k2"),
            F.size(F.split("norm", " ")).cast("long").alias("words"),
        )
        .distinct()
    )


def _replies(parsed: DataFrame) -> DataFrame:
    """(place, reply_to, n_linked) of the messages with a linked quotation.

    The first message that says a passage is one aggregate row per passage, folded before the shuffle,
    so a passage with a third of all rows is joined with one row.
    """
    units = _units(parsed)
    said = units.where("level = 0").groupBy("conv_id", "k1", "k2").agg(F.min("at").alias("original"))
    q, s = units.where("level > 0").alias("q"), said.alias("s")
    same = F.col("q.conv_id").eqNullSafe(F.col("s.conv_id"))
    linked = (
        q.join(s, same & (F.col("q.k1") == F.col("s.k1")) & (F.col("q.k2") == F.col("s.k2")))
        .where("s.original < q.at")
        .groupBy("place", "level", "original")
        .agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    )
    best = F.max(F.struct((-F.col("level")).alias("l"), "words", "original"))
    return linked.groupBy("place").agg(best["original"].alias("reply_to"), F.sum("n").alias("n_linked"))


def _thread_starts(parents: DataFrame) -> DataFrame:
    """(conv_id, at, thread_turn): the first message of the thread, by doubling the steps upward.

    A reply is later than its original, so there are no rings; rounds grow with the logarithm of the
    longest chain, and each is written to the shared folder.
    """
    now = staged(parents, "quote-parents")
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("thread_turn").alias("t"))
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("thread_turn") == F.col("a"))
        step = now.join(up, same, "left").select(
            "conv_id", "at", F.coalesce("t", "thread_turn").alias("thread_turn"), F.col("t").isNotNull().alias("moved")
        )
        moved = staged(step, "quote-threads")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def linked_messages(messages: DataFrame) -> DataFrame:
    """One row per message: (conv_id, turn, role, thread_turn, reply_to, position, n_quoted_lines, n_linked, body).

    body is the text without quoted lines, trimmed; thread_turn the turn that began the thread, its own
    if it replies to nothing; reply_to the turn it replies to, or null; position its place in the
    conversation in reply order, from 0. A null text is empty. A null conv_id is a conversation of
    its own, a null turn counts as before turn 0. Rows that share a turn are all kept and follow one
    another; their thread is that of the earliest message any of them replies to. Other columns are
    not read; an empty table gives an empty table.
    """
    parsed = staged(_parsed(messages), "quote-lines")
    replies = staged(_replies(parsed), "quote-replies")
    own = parsed.select("place", "conv_id", "at").join(replies, "place")
    parents = own.groupBy("conv_id", "at").agg(F.min("reply_to").alias("thread_turn"))
    threads = _thread_starts(parents).select(
        F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("thread_turn").alias("t")
    )
    bodies = F.expr("transform(filter(sequence(0, size(levels) - 1), i -> levels[i] = 0), i -> bodies[i])")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a"))
    placed = (
        parsed.join(replies, "place", "left")
        .join(threads, same, "left")
        .select(
            "place", "conv_id", "turn", "at", "role", "reply_to",
            F.coalesce("t", "at").alias("thread_turn"),
            F.size(F.filter("levels", lambda x: x > 0)).cast("long").alias("n_quoted_lines"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.btrim(F.array_join(bodies, "\n"), F.lit("\n\r\t ")).alias("body"),
            F.lit(1).alias("one"),
        )
    )
    placed = staged(placed, "quote-placed")
    sizes = placed.groupBy("conv_id", "thread_turn").agg(F.count("*").alias("size"))
    before = blocked_running_sum(sizes, ["conv_id"], ["thread_turn"], "size", "earlier").alias("b")
    inside = blocked_running_sum(placed, ["conv_id", "thread_turn"], ["at", "place"], "one", "inner").alias("m")
    both = F.col("m.conv_id").eqNullSafe(F.col("b.conv_id")) & (
        F.col("m.thread_turn") == F.col("b.thread_turn")
    )
    return inside.join(before, both).select(
        "m.conv_id", "m.turn", "m.role", "m.thread_turn", "m.reply_to",
        (F.col("b.earlier") + F.col("m.inner")).cast("long").alias("position"),
        "m.n_quoted_lines", "m.n_linked", "m.body",
    )


def formatted(linked: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_messages, text): conversations in reply order as ``<|role|>`` and body.

    A part holds at most ``part`` messages, so that a conversation of any length is never one row.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body")
    return (
        linked.select("conv_id", F.floor(F.col("position") / part).alias("part"), "position", line.alias("line"))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("all"))
        .select(
            "conv_id", "part", F.size("all").alias("n_messages"),
            F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"),
        )
    )
