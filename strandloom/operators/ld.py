"""Linkage disequilibrium: band-limited r squared and independent blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A variant is alone without a link of this strength within this distance.
ALONE_R2, ALONE_GAP = 0.1, 10

EDGES = "chrom string, i int, j int, r2 double"


def ld_edges(common: DataFrame, cutoff: float = 0.1, window: int = 100, tile: int = 512) -> DataFrame:
    """``chrom, i, j, r2`` for ``0 < j - i <= window`` and ``r2 > cutoff`` (common indices).

    Variants are dealt into tiles of ``tile`` neighbours; the last ``window`` of a
    tile are also sent to the next one, so each pair meets in one task and a row
    moves at most twice.  A task multiplies matrices of small integers: sums are
    exact, r squared has one division at its end, and is 0 without variance.
    """
    tile = max(tile, window)
    own = F.floor(F.col("c_idx") / tile).cast("int")
    halo = F.col("c_idx") % tile >= tile - window
    tiles = F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own)))
    rows = common.select("chrom", "c_idx", "dosage", tiles.alias("tile"))

    def pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("c_idx")
        idx = table.column("c_idx").to_numpy()
        flat = table.column("dosage").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(idx), -1).astype(np.float64)
        n = x.shape[1]
        mine = idx // tile == key[1].as_py()
        s, q = x.sum(axis=1), np.square(x).sum(axis=1)
        spread = n * q - s * s
        cov = n * (x[mine] @ x.T) - np.outer(s[mine], s)
        scale = np.outer(spread[mine], spread)
        r2 = np.divide(cov * cov, scale, out=np.zeros_like(scale), where=scale > 0)
        gap = idx[mine][:, None] - idx[None, :]
        b, a = np.nonzero((gap > 0) & (gap <= window) & (r2 > cutoff))
        return pa.table(
            [
                pa.array([key[0].as_py()] * len(a), pa.string()),
                pa.array(idx[a], pa.int32()),
                pa.array(idx[mine][b], pa.int32()),
                pa.array(r2[b, a]),
            ],
            names=["chrom", "i", "j", "r2"],
        )

    return rows.groupBy("chrom", "tile").applyInArrow(pairs, EDGES)


def gap_break(edges: DataFrame, gap: int = 10) -> DataFrame:
    """Right-hand edges up to the first step of more than ``gap`` between hits of one variant."""
    order = Window.partitionBy("chrom", "i").orderBy("j")
    step = F.col("j") - F.lag("j").over(order)
    rows = edges.withColumn("broken", (F.coalesce(step, F.col("j") - F.col("i")) > gap).cast("int"))
    return rows.withColumn("broken", F.max("broken").over(order)).where("broken = 0").drop("broken")


def gap_break_left(edges: DataFrame, gap: int = 10) -> DataFrame:
    """The same towards smaller indices, seen from ``j``."""
    order = Window.partitionBy("chrom", "j").orderBy(F.desc("i"))
    step = F.lag("i").over(order) - F.col("i")
    rows = edges.withColumn("broken", (F.coalesce(step, F.col("j") - F.col("i")) > gap).cast("int"))
    return rows.withColumn("broken", F.max("broken").over(order)).where("broken = 0").drop("broken")


def ld_neighbours(common: DataFrame, edges: DataFrame, gap: int = 10) -> DataFrame:
    """``chrom, i, neighbours``: sorted linked indices of each variant, itself included."""
    right = gap_break(edges, gap).select("chrom", "i", F.col("j").alias("k"))
    left = gap_break_left(edges, gap).select("chrom", F.col("j").alias("i"), F.col("i").alias("k"))
    own = common.where(has_variance()).select("chrom", F.col("c_idx").alias("i"), F.col("c_idx").alias("k"))
    lists = right.unionByName(left).unionByName(own).groupBy("chrom", "i").agg(F.array_sort(F.collect_set("k")).alias("neighbours"))
    every = common.select("chrom", F.col("c_idx").alias("i")).join(lists, ["chrom", "i"], "left")
    return every.withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<int>")))


def has_variance():
    n = F.size("dosage")
    total = F.aggregate("dosage", F.lit(0).cast("long"), lambda s, x: s + x)
    squares = F.aggregate("dosage", F.lit(0).cast("long"), lambda s, x: s + x * x)
    return n * squares - total * total > 0


def reach(common: DataFrame, edges: DataFrame, gap: int = 10) -> DataFrame:
    """``chrom, c_idx, reach``: the farthest linked variant to the right, or itself."""
    far = gap_break(edges, gap).groupBy("chrom", F.col("i").alias("c_idx")).agg(F.max("j").alias("far"))
    rows = common.select("chrom", "c_idx").join(far, ["chrom", "c_idx"], "left")
    return rows.select("chrom", "c_idx", F.coalesce("far", "c_idx").alias("reach"))


def cummax_blocks(reached: DataFrame) -> DataFrame:
    """``chrom, block_ord, left_c, right_c``: runs that no link leaves."""
    order = Window.partitionBy("chrom").orderBy("c_idx")
    ends = reached.withColumn("so_far", F.max("reach").over(order)).where("so_far = c_idx")
    rows = ends.select("chrom", (F.lag("c_idx", 1, -1).over(order) + 1).alias("left_c"), F.col("c_idx").alias("right_c"))
    return rows.withColumn("block_ord", F.row_number().over(Window.partitionBy("chrom").orderBy("left_c")) - 1)


def merge_singletons(blocks: DataFrame) -> DataFrame:
    """Leading singletons join the first longer block; later ones extend the one before.

    A chromosome of singletons alone becomes one block.
    """
    order = Window.partitionBy("chrom").orderBy("left_c")
    multi = (F.col("right_c") > F.col("left_c")).cast("int")
    before = F.coalesce(F.sum("multi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("multi", multi).withColumn("before", before)
    start = (F.row_number().over(order) == 1) | ((F.col("multi") == 1) & (F.col("before") > 0))
    return _merge(rows, start, order, "left_c", "right_c")


def _merge(rows: DataFrame, start, order, left: str, right: str) -> DataFrame:
    """Merge runs of rows that begin where ``start`` holds."""
    rows = rows.withColumn("block_ord", (F.sum(start.cast("int")).over(order) - 1).cast("int"))
    return rows.groupBy("chrom", "block_ord").agg(F.min(left).alias(left), F.max(right).alias(right))


def independent_blocks_common(common: DataFrame, cutoff: float = 0.1, window: int = 100) -> DataFrame:
    return merge_singletons(cummax_blocks(reach(common, ld_edges(common, cutoff, window))))


def alone_variants(common: DataFrame, cutoff: float = ALONE_R2, gap: int = ALONE_GAP, edges: DataFrame | None = None) -> DataFrame:
    """Common variants that vary and have no link within ``gap`` on either side.

    ``edges``: links of ``cutoff`` over ``gap`` or more, where they are at hand.
    """
    near = ld_edges(common, cutoff, gap) if edges is None else edges.where(F.col("j") - F.col("i") <= gap)
    linked = near.select("chrom", F.col("i").alias("c_idx")).unionByName(near.select("chrom", F.col("j").alias("c_idx")))
    rows = common.where(has_variance()).select("chrom", "chrom_ord", "c_idx", "var_idx", "pos", "var_id")
    return rows.join(linked, ["chrom", "c_idx"], "left_anti")
