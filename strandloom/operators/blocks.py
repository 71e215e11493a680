"""Blocks on the full variant index: conversion, merging, tiling, membership.

Sequential merges are written in closed form, so each is a window over the
blocks of a chromosome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ld import _merge

#: Variants of a bin of the interval join.
BIN = 1024


def _order():
    return Window.partitionBy("chrom").orderBy("left_idx")


def to_full_index(blocks: DataFrame, index: DataFrame, last: DataFrame) -> DataFrame:
    """Blocks of common indices as blocks that tile all variants of the chromosome.

    A block starts after the last variant of the one before, so rare variants in
    between go to the right; the first starts at 0, the last ends at the end.
    """
    ends = blocks.join(index.withColumnRenamed("c_idx", "right_c"), ["chrom", "right_c"])
    order = Window.partitionBy("chrom").orderBy("left_c")
    rows = ends.select(
        "chrom",
        F.coalesce(F.lag("var_idx").over(order) + 1, F.lit(0)).alias("left_idx"),
        F.col("var_idx").alias("right_idx"),
        F.lead("var_idx").over(order).isNull().alias("is_last"),
    )
    # One row per chromosome.
    rows = rows.join(F.broadcast(last), "chrom")
    return rows.select("chrom", "left_idx", F.when(F.col("is_last"), F.col("last_idx")).otherwise(F.col("right_idx")).alias("right_idx"))


def _with_neighbours(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("prev_right", F.lag("right_idx").over(_order())).withColumn(
        "first_left", F.min("left_idx").over(_order())
    )


def merge_narrow(blocks: DataFrame, width: int = 10) -> DataFrame:
    """Blocks with ``right - left < width`` join the one before; at the front, the one after."""
    rows = _with_neighbours(blocks)
    wide = (F.col("right_idx") - F.col("left_idx") >= width) & (F.col("prev_right") - F.col("first_left") >= width)
    return _merge(rows, F.coalesce(wide, F.lit(True)), _order(), "left_idx", "right_idx")


def merge_narrow_fine(blocks: DataFrame, independent: DataFrame, width: int = 2) -> DataFrame:
    """As :func:`merge_narrow`, but a block with an edge on an independent breakpoint stays."""
    edges = independent.select("chrom", F.explode(F.array("left_idx", "right_idx")).alias("edge")).distinct()
    rows = _with_neighbours(blocks)
    for side in ("left", "right"):
        known = edges.select("chrom", F.col("edge").alias(f"{side}_idx"), F.lit(True).alias(f"{side}_touches"))
        rows = rows.join(known, ["chrom", f"{side}_idx"], "left")
    touches = F.coalesce("left_touches", F.lit(False)) | F.coalesce("right_touches", F.lit(False))
    start = ((F.col("right_idx") - F.col("left_idx") >= width) | touches) & (F.col("prev_right") - F.col("first_left") >= width)
    return _merge(rows, F.coalesce(start, F.lit(True)), _order(), "left_idx", "right_idx")


def uniform_partition(blocks: DataFrame, step: int, left: str = "left_c", right: str = "right_c", least: int = 5) -> DataFrame:
    """Cut blocks into runs of ``step``; blocks with ``right - left < least`` stay whole."""
    if step < 1:
        raise ValueError("step must be at least 1")
    l, r = F.col(left), F.col(right)
    starts = F.when(r - l < least, F.array(l)).otherwise(F.sequence(l, r, F.lit(step)))
    rows = blocks.select("chrom", F.col(right).alias("_end"), (r - l < least).alias("_whole"), F.explode(starts).alias(left))
    end = F.when(F.col("_whole"), F.col("_end")).otherwise(F.least(F.col(left) + step - 1, F.col("_end")))
    rows = rows.select("chrom", left, end.alias(right))
    return rows.withColumn("block_ord", F.row_number().over(Window.partitionBy("chrom").orderBy(left)) - 1)


def variant_blocks(variants: DataFrame, blocks: DataFrame, bin_size: int = BIN) -> DataFrame:
    """``chrom, var_idx, block_ord`` where ``left_idx <= var_idx <= right_idx``.

    Blocks may leave gaps, overlap, repeat or reach beyond the last variant: a
    variant is in none, one or several.  The index is cut into bins; a block goes
    to each bin that it touches, a variant to its own, and equal bins meet, so
    no chromosome passes through one task.  A block whose ends are the wrong way
    round has no variants.
    """
    if bin_size < 1:
        raise ValueError("bin_size must be at least 1")
    bins = F.sequence(F.expr(f"left_idx div {bin_size}"), F.expr(f"right_idx div {bin_size}"))
    touched = blocks.where("left_idx <= right_idx").select("chrom", "block_ord", "left_idx", "right_idx", F.explode(bins).alias("bin"))
    rows = variants.select("chrom", "var_idx", F.expr(f"var_idx div {bin_size}").alias("bin"))
    met = rows.join(touched, ["chrom", "bin"]).where(F.col("var_idx").between(F.col("left_idx"), F.col("right_idx")))
    return met.select("chrom", "var_idx", "block_ord")


def block_names(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``block``: ``chrom@pos of the first variant-pos of the last``."""
    at = variants.select("chrom", "var_idx", "pos")
    rows = blocks
    for side in ("left", "right"):
        rows = rows.join(at.select("chrom", F.col("var_idx").alias(f"{side}_idx"), F.col("pos").alias(f"{side}_pos")), ["chrom", f"{side}_idx"])
    name = F.concat("chrom", F.lit("@"), "left_pos", F.lit("-"), "right_pos")
    return rows.select("chrom", "block_ord", "left_idx", "right_idx", name.alias("block"))
