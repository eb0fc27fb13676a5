"""Chat formatting after collapsing cumulative snapshots.

A conversation that was logged after every turn appears many times, each log the prefix of a longer one. Every prefix
of a conversation has a rolling hash: the exclusive-or of the hashes of its turns, each taken together with its
place, which a running window keeps. A conversation whose hash is that of a shorter prefix of another is a snapshot;
an anti-join drops it. Two hashes of 64 bits are kept, so 128 bits have to agree. What is left is rendered. Turns are
brought to the form in which they are shown before they are hashed: two logs that look alike are alike.

Turns without a conversation's number are conversations of one turn each, as nothing ties them together; they need no
window, and equal ones become one by partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stored

#: Roles of the template; others are rendered as "user".
ROLES = ("system", "user", "assistant", "tool")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def shown(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role (one of ROLES), text (trimmed, and safe to render)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    role = F.lower(F.trim(role))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(role.isin(*ROLES), role).otherwise(F.lit("user")).alias("role"), safe(text).alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ...), role, text, h1, h2 (of the turns up to this one), last (whether it is the last) of shown turns."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    x = turns.where("conv_id IS NOT NULL").withColumn("pos", F.row_number().over(order)).withColumn("last", F.lead(F.lit(True), 1).over(order).isNull())
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    lone = turns.where("conv_id IS NULL").withColumn("pos", F.lit(1)).withColumn("last", F.lit(True))
    for k, salt in (("h1", 1), ("h2", 2)):
        one = F.xxhash64(F.lit(salt), "pos", "role", "text")
        x, lone = x.withColumn(k, F.bit_xor(one).over(run)), lone.withColumn(k, one)
    return x.unionByName(lone)


def maximal(marks: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, lone of the conversations that stay: one of each that no longer one begins with.

    marks: conv_id, pos, last, h1, h2, role, text. Equal conversations are one, under the smallest conv_id (null last).
    lone: role and text of a conversation that has no conv_id, else null.
    """
    key = ["pos", "h1", "h2"]
    lone = F.min(F.when(F.col("conv_id").isNull(), F.struct("role", "text")))
    whole = marks.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), lone.alias("lone"))
    inner = marks.where("NOT last").select(*key).distinct()
    left = whole.join(inner, key, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "copies", "lone")
    return left.withColumn("lone", F.when(F.col("conv_id").isNull(), F.col("lone")))


def safe(text: Column) -> Column:
    """A turn's text; the template's own marks in it are broken by a space, so that they can't close a turn."""
    return F.trim(F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>")))


def render(role: Column, text: Column) -> Column:
    """A shown turn in the template."""
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, chat: the maximal conversations, rendered.

    turns: conv_id, turn, role, text. Turns go by number (null last), ties by role and text as shown; null roles and
    texts count as empty; each row without a conv_id is a conversation by itself. A repeated row is a further turn. An
    empty table gives an empty result; other columns are ignored. A conversation becomes one row, so its text has to
    fit in one.
    """
    x = stored(prefixes(shown(turns)), "chat-turns")
    stay = stored(maximal(x), "chat-stay")
    named = stay.where("conv_id IS NOT NULL").drop("lone")
    kept = x.where("conv_id IS NOT NULL").select("conv_id", "pos", render(F.col("role"), F.col("text")).alias("turn")).join(named, "conv_id")
    chat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn"))), lambda s: s["turn"]), "")
    out = kept.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), chat.alias("chat"))
    return out.unionByName(stay.where("conv_id IS NULL").select("conv_id", "n_turns", "copies", render(F.col("lone.role"), F.col("lone.text")).alias("chat")))
