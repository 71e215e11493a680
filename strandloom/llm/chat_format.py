r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is under the loss mask.  Turns after the last
assistant turn form one more row without a target, so nothing is lost.

A turn is written ``<turn:ROLE>TEXT</turn>`` and a line feed.  In texts and
roles ``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``, so no
control string can occur inside them, and reading is exact.  Only DataFrame
functions are used.  A conversation is one row, as its output is; the examples
of one conversation grow with the square of its turns, as the method says.

Nulls and edge cases: a null text or role is empty; null turns come first, equal
turns are ordered by role and text, repeated rows stay; a conversation without
an assistant turn gives one row without a target; rows with a null conversation
id belong to no conversation and are left out; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
END = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def prefix_examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """``conv_id, target, text, loss_start, loss_end`` from ``conv_id, turn, role, text``.

    ``target`` is the number (from 0) of the reply among the turns, or null in a
    row of closing turns; the mask is ``[loss_start, loss_end)`` in characters.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    talks = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    header = lambda t: F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">"))
    talks = talks.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == target_role).alias("is_target"),
        F.transform("turns", header).alias("headers"),
        F.transform("turns", lambda t: F.concat(header(t), escape(t["text"]), F.lit(END))).alias("pieces"),
    )
    last = F.size("pieces") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda k: F.col("is_target")[k] | (k == last))
    rows = talks.select("*", F.explode(targets).alias("k"))
    rows = rows.withColumn("context", F.array_join(F.slice("pieces", 1, F.col("k")), ""))
    rows = rows.withColumn("piece", F.col("pieces")[F.col("k")]).withColumn("masked", F.col("is_target")[F.col("k")])
    start = F.char_length("context") + F.char_length(F.col("headers")[F.col("k")])
    end = F.char_length("context") + F.char_length("piece") - len(END)
    return rows.select(
        "conv_id",
        F.when(F.col("masked"), F.col("k")).alias("target"),
        F.concat("context", "piece").alias("text"),
        F.when(F.col("masked"), start).otherwise(0).alias("loss_start"),
        F.when(F.col("masked"), end).otherwise(0).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """Structs ``role, text`` of a formatted text."""
    pieces = F.filter(F.split(text, F.lit(END)), lambda p: p != "")
    head = lambda p: F.substring_index(p, ">", 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(head(p), F.lit(len("<turn:") + 1), F.char_length(p))).alias("role"),
            unescape(F.substring(p, F.char_length(head(p)) + 2, F.char_length(p))).alias("text"),
        ),
    )


def read_examples(examples: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_texts, formatted_chars`` read back from examples."""
    masked = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    loss = F.when(F.col("target").isNotNull(), F.struct("target", masked.alias("loss")))
    talks = examples.groupBy("conv_id").agg(
        F.max_by("text", F.char_length("text")).alias("whole"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.char_length("text")).alias("formatted_chars"),
    )
    return talks.select(
        "conv_id", read_turns(F.col("whole")).alias("turns"), F.col("losses.loss").alias("loss_texts"), "formatted_chars"
    )
