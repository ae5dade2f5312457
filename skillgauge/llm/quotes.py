"""Quotation linking and reply-ordered conversations (operator 2).

A line that begins with `>` marks is quoted, as deep as it has marks. Consecutive lines of one depth
are a passage, and so is each of them, since a reply may quote a part; passages are compared by a
digest of their words in lower case, whatever the line breaks. A quoted passage points
to the earliest message that holds it unquoted, in the same conversation if there is one, else
anywhere, and only if that message comes before. A message replies to the original of its shallowest
linked passage, the latest one among equals; without a linked passage it replies to the first message
of its conversation. Following these replies gives the root and the depth of every message, by
doubling: each round doubles the distance covered.

The earliest message of a passage is an aggregate, so a phrase that very many messages share costs a
row a task, and quoting messages are joined to that one row.

Defined results: messages are ordered by conversation, turn and a digest of role and text, nulls
first; rows equal in all of these are one message and give equal rows; a null text is empty; a message
without a conversation is its own root unless it quotes; a text that is all quotes leaves an empty
text; a passage without words links nothing; an empty table gives an empty table; only the four named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.llm.storage import stored

_MARKS = r"^(?:[ \t]*>)+[ \t]?"
_INTRODUCES = r"^[ \t]*(?:On|Am|Le|El)\b.*:[ \t]*$"


def _lines(text: Column) -> Column:
    """depth, body of every line."""

    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, _MARKS, 0)
        return F.struct(
            F.length(F.regexp_replace(marks, "[^>]+", "")).alias("depth"), F.substr(raw, F.length(marks) + 1).alias("body")
        )

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), line)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed_messages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """message (conversation, turn, digest), role, passages (depth, digest), pieces (passages and their lines), clean_text."""
    body = F.col(f"`{text}`")
    digest = F.xxhash64(F.col(f"`{role}`"), body)
    df = messages.select(
        F.struct(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest")).alias("message"),
        F.col(f"`{role}`").alias("role"),
        _lines(body).alias("lines"),
    )
    line = F.col("lines")
    depth = lambda i: F.get(line, i)["depth"]
    worded = lambda i: F.coalesce(F.get(line, i)["body"].rlike(r"[\p{L}\p{N}]"), F.lit(False))
    breaks = lambda i, beside: ~worded(beside) | (depth(beside) != depth(i))
    numbers = F.sequence(F.lit(0), F.size(line) - 1)
    df = df.withColumn("numbers", numbers)
    df = df.withColumn("begins", F.filter("numbers", lambda i: worded(i) & breaks(i, i - 1)))
    df = df.withColumn("ends", F.filter("numbers", lambda i: worded(i) & breaks(i, i + 1)))

    def passage(begin: Column, end: Column) -> Column:
        bodies = F.transform(F.slice(line, begin + 1, end - begin + 1), lambda part: part["body"])
        return F.struct(depth(begin).alias("depth"), F.unhex(F.md5(_normal(F.array_join(bodies, " ")))).alias("digest"))

    def piece(i: Column) -> Column:
        return F.struct(depth(i).alias("depth"), F.unhex(F.md5(_normal(F.get(line, i)["body"]))).alias("digest"))

    df = df.withColumn("passages", F.zip_with("begins", "ends", passage))
    single = F.transform(F.filter("numbers", worded), piece)
    own = lambda i: (depth(i) == 0) & ~(F.get(line, i)["body"].rlike(_INTRODUCES) & F.coalesce(depth(i + 1) > 0, F.lit(False)))
    clean = F.array_join(F.transform(F.filter("numbers", own), lambda i: F.get(line, i)["body"]), "\n")
    return df.select(
        "message",
        "role",
        "passages",
        F.array_distinct(F.concat("passages", single)).alias("pieces"),
        F.trim(F.regexp_replace(F.regexp_replace(clean, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")).alias("clean_text"),
    )


def quotation_links(parsed: DataFrame) -> DataFrame:
    """message, depth, original: each quoted passage or line that has an original."""
    each = parsed.select("message", F.explode_outer("pieces").alias("p")).filter(F.col("p").isNotNull())
    each = each.select("message", "p.depth", "p.digest")
    unquoted = each.filter("depth = 0")
    quoted = each.filter("depth > 0").distinct()
    inside = unquoted.groupBy(F.struct("digest", "message.conv").alias("key")).agg(F.min("message").alias("near"))
    anywhere = unquoted.groupBy("digest").agg(F.min("message").alias("far"))
    found = quoted.withColumn("key", F.struct("digest", "message.conv")).join(inside, "key", "left").join(anywhere, "digest", "left")
    before = lambda name: F.when(F.col(name) < F.col("message"), F.col(name))
    return found.select("message", "depth", F.coalesce(before("near"), before("far")).alias("original")).filter(F.col("original").isNotNull())


def reply_parents(parsed: DataFrame, links: DataFrame) -> DataFrame:
    """message, parent (or null): one row per distinct message."""
    # The latest original of the shallowest depth: depths are made negative, so that one maximum does.
    best = links.groupBy("message").agg(F.max(F.struct((-F.col("depth")).alias("level"), "original")).alias("best"))
    opener = parsed.filter(F.col("message.conv").isNotNull()).groupBy(F.col("message.conv").alias("conv")).agg(F.min("message").alias("opener"))
    every = parsed.select("message").distinct().join(best, "message", "left")
    joined = every.withColumn("conv", F.col("message.conv")).join(opener, "conv", "left")
    first = F.when(F.col("opener") < F.col("message"), F.col("opener"))
    return joined.select("message", F.coalesce("best.original", first).alias("parent"))


def roots(parents: DataFrame) -> DataFrame:
    """message, parent, root, depth, by pointer doubling."""
    state = stored(
        parents.select("message", "parent", F.coalesce("parent", "message").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "replies"
    )
    while True:
        above = state.select(F.col("message").alias("at"), F.col("root").alias("higher"), F.col("depth").alias("further"))
        # Messages whose pointer has reached a root point to themselves from there on.
        moved = state.join(above, state["root"] == above["at"]).select(
            "message", "parent", F.col("higher").alias("root"), (F.col("depth") + F.col("further")).cast("int").alias("depth"), (F.col("further") > 0).alias("moved")
        )
        moved = stored(moved, "replies")
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return state


def linked_conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: its place in its reply-ordered conversation and its text without quotes.

    Within a root, rows ordered by depth and turn stand in reply order.
    """
    parsed = stored(parsed_messages(messages, conversation, turn, role, text), "messages")
    links = stored(quotation_links(parsed), "quotations")
    placed = roots(reply_parents(parsed, links))
    linked = links.groupBy("message").agg(F.count("*").alias("n_linked"))
    rows = parsed.join(placed, "message").join(linked, "message", "left")
    return rows.select(
        F.col("message.conv").alias("conv_id"),
        F.col("message.turn").alias("turn"),
        "role",
        F.col("parent.conv").alias("parent_conv"),
        F.col("parent.turn").alias("parent_turn"),
        F.col("root.conv").alias("root_conv"),
        F.col("root.turn").alias("root_turn"),
        "depth",
        F.size(F.filter("passages", lambda passage: passage["depth"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "clean_text",
    )
