"""Quotation linking: reply-ordered conversations without quotes.

Lines of a message that start with ``>`` marks are quoted, one level per mark;
the rest is its own text. Every line is normalised (case, marks, white space)
and hashed. A quoted line belongs to the first message that has it as its own:
in the same conversation if that is earlier there, else the first anywhere that
comes before. A message replies to the message that most of its quoted lines of
the outermost linked level come from. Pointer doubling over the reply links
gives each message its thread's root and its depth.

Both joins meet one row per line hash (an aggregate), so a line that thousands
of messages hold or quote makes no pairs. A thread is rows with sort columns, not
one collected value. A reply's message comes before it by (conv_id, turn), so
links form no cycle.

Defined cases: null text is empty; a message that quotes nothing known, and one
without conversation or turn, is a root; rows that repeat (conv_id, turn) are one
message with all their lines, and each row is kept; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import cut, text_of

_QUOTE = r"(?s)^((?:[ \t]*+>)*+)[ \t]?(.*)$"
#: The line that mail programs put above a quotation.
_SAID = r"(?s)^(On\b.{1,200}\bwrote|Am\b.{1,200}\bschrieb|Le\b.{1,200}\ba écrit|El\b.{1,200}\bescribió)\s?:$"
#: White space, Unicode's too; lines end at \n or \r\n only, so it may stand inside one.
_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
_ID = ["conv_id", "turn"]


def lines(text: Column) -> Column:
    """(level, body) of each line; attribution lines are left out."""
    parts = F.transform(F.split(text, r"\r?\n", -1), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), "[^>]", "")).alias("level"),
        F.regexp_extract(x, _QUOTE, 2).alias("body")))
    return F.filter(parts, lambda p: ~F.trim(p["body"]).rlike(_SAID))


def _hash(body: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(body), _SPACE, " "))
    return F.when(plain != "", F.xxhash64(plain))


def reply_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, quoted, linked, reply_to (conv_id, turn) of each message with quotes; ``rows``: with lines."""
    each = (rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(*_ID, F.explode("lines").alias("l"))
            .select(*_ID, "l.level", _hash(F.col("l.body")).alias("h")).where("h IS NOT NULL"))
    own = each.where("level = 0")
    here = cut(own.groupBy("conv_id", "h").agg(F.min("turn").alias("_first")))
    anywhere = cut(own.groupBy("h").agg(F.min(F.struct(*_ID)).alias("_any")))
    quoted = cut(each.where("level > 0"))
    local = quoted.join(here, ["conv_id", "h"], "left")
    known = F.col("_first") < F.col("turn")
    near = local.where(known).select(*_ID, "level", F.struct("conv_id", F.col("_first").alias("turn")).alias("of"))
    far = (local.where(~F.coalesce(known, F.lit(False))).join(anywhere, "h", "left")
           .select(*_ID, "level", F.when(F.col("_any") < F.struct(*_ID), F.col("_any")).alias("of")))
    votes = near.unionByName(far).groupBy(*_ID, "of").agg(F.min("level").alias("level"), F.count("*").alias("n"))
    best = F.when(F.col("of").isNotNull(), F.struct(-F.col("level"), F.col("n"), F.col("of")))
    return votes.groupBy(*_ID).agg(
        F.sum("n").alias("quoted"), F.sum(F.when(F.col("of").isNotNull(), F.col("n")).otherwise(0)).alias("linked"),
        F.max_by("of", best).alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root (conv_id, turn) and depth of each message with a ``reply_to``."""
    up = cut(links.where("reply_to IS NOT NULL").select(F.struct(*_ID).alias("id"), F.col("reply_to").alias("to"), F.lit(1).cast("long").alias("depth")))
    open_, done = up, None
    while True:
        # an unfinished message takes its ancestor's ancestor; an ancestor without one is a root
        step = up.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"))
        next_ = cut(open_.join(step, "to", "left"))
        ended, more = next_.where("_to IS NULL").select("id", "to", "depth"), next_.where("_to IS NOT NULL")
        done = ended if done is None else done.unionByName(ended)
        if not more.limit(1).count():
            return done.select("id.conv_id", "id.turn", F.col("to").alias("root"), "depth")
        open_ = more.select("id", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"))
        up = open_.unionByName(done)


def conversations(messages: DataFrame) -> DataFrame:
    """thread_conv, thread_turn, depth, conv_id, turn, role, reply_conv, reply_turn, quoted, linked, text.

    One row per message row; ordered by the first five columns, a thread reads
    in reply order. ``text`` is the message without quotes.
    """
    rows = messages.select(*_ID, "role", lines(text_of()).alias("lines"))
    links = cut(reply_links(rows))
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda p: p["level"] == 0), lambda p: p["body"]), "\n"))
    clean = rows.withColumn("text", F.regexp_replace(own, r"^\n++|\n++\z", "")).drop("lines")
    info = links.join(threads(links), _ID, "left")
    zero = F.lit(0).cast("long")
    return clean.join(info, _ID, "left").select(
        F.coalesce("root.conv_id", "conv_id").alias("thread_conv"), F.coalesce("root.turn", "turn").alias("thread_turn"),
        F.coalesce("depth", zero).alias("depth"), *_ID, "role",
        F.col("reply_to.conv_id").alias("reply_conv"), F.col("reply_to.turn").alias("reply_turn"),
        F.coalesce("quoted", zero).alias("quoted"), F.coalesce("linked", zero).alias("linked"), "text")
