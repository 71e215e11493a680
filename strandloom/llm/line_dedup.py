"""Line dedup over overlapping windows of three lines.

Lines are compared without the spaces around them; blank lines take no part and
stay.  Every three consecutive lines of a document that are not blank form a
window.  A window whose lines also occur as a window earlier (smaller
``doc_id``, or same document and earlier line) covers its lines; covered
positions are merged, and those lines are removed.

The first place of each window comes from a group-by with partial aggregation;
places then meet their first place in a join whose hot partitions adaptive
execution can split.  Only DataFrame functions are used.

Nulls and edge cases: a null text has no lines and stays null; documents of
fewer than three lines are kept whole; a text that loses nothing is unchanged;
one that loses every line keeps its row; a window counts as earlier by
``(doc_id, line)``, so equal rows do not cut each other, and rows that share a
``doc_id`` but not the text (told apart by a hash of it) are each cut at their
own lines; a null ``doc_id`` has no place, so its row is neither cut nor
compared; an empty table gives no rows; further columns are handed on only by
``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import quoted


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _full(text: Column) -> Column:
    """Structs ``at, line`` of the lines that are not blank."""
    lines = F.transform(_lines(text), lambda line, at: F.struct(at.alias("at"), F.trim(line).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def repeated_windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """``doc_id, hash, start``: windows (by line number) that occur earlier as well.

    ``docs`` has ``doc_id, text`` and a ``hash`` of the text.
    """
    full = docs.where("doc_id is not null").select("doc_id", "hash", _full(F.col("text")).alias("full"))
    full = full.where(F.size("full") >= window)
    starts = F.explode(F.sequence(F.lit(0), F.size("full") - window))
    spots = full.select("doc_id", "hash", "full", starts.alias("start"))
    lines = [F.col("full")[F.col("start") + k]["line"] for k in range(window)]
    spots = spots.select("doc_id", "hash", "start", F.unhex(F.md5(F.concat_ws("\n", *lines))).alias("print"))
    place = F.struct("doc_id", "start")
    firsts = spots.groupBy("print").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    return spots.join(firsts.select("print", "first"), "print").where(place != F.col("first")).select("doc_id", "hash", "start")


def line_dedup(
    docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` and the columns ``keep`` of every row.

    ``n_lines`` counts lines that are not blank.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"),
        *[F.col(quoted(c)).alias(f"_keep_{k}") for k, c in enumerate(keep)],
    )
    found = repeated_windows(rows.select("doc_id", "text", "hash"), window)
    found = found.groupBy("doc_id", "hash").agg(F.collect_set("start").alias("starts"))
    rows = rows.join(found, ["doc_id", "hash"], "left").withColumn("full", _full(F.col("text")))
    fits = F.filter("starts", lambda s: s + window <= F.size("full"))
    covered = F.array_distinct(F.flatten(F.transform(fits, lambda s: F.sequence(s, s + (window - 1)))))
    rows = rows.withColumn("cut", F.transform(covered, lambda k: F.col("full")[k]["at"]))
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("cut"))
    rows = rows.withColumn("lines", lines).withColumn("stay", stay)
    text = F.when(F.size("cut") > 0, F.array_join(F.transform("stay", lambda k: F.col("lines")[k]), "\n"))
    return rows.select(
        "doc_id",
        F.size("full").cast("long").alias("n_lines"),
        F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long").alias("n_removed"),
        F.coalesce(text, F.col("text")).alias("text"),
        *[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)],
    )
