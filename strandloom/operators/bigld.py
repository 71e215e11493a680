"""Fine partition of independent blocks by cliques of strong correlation.

An approximation after the published descriptions of the Big-LD method: within
an independent block, variants with ``abs(r) > cutoff`` are linked; stretches
whose ends are linked and whose pairs are linked densely become intervals,
weighted by their variants; a set of disjoint intervals of the largest weight
gives the blocks, and what is between them goes to the block on its left.  It is
not a replica.

Links come from the band join.  The links within a stretch are two-dimensional
prefix sums over the links: a running count over the right ends of each left
variant, then a running sum of these over the left variants of each right end,
both windows over no more than a variant's reach.  The choice of intervals reads
each block's intervals in order of their ends and holds three numbers for each
end that improves on the one before; no genotypes reach it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.blocks import variant_blocks
from strandloom.operators.ld import ld_edges
from strandloom.sources.scratch import written

#: Variants further apart than this are not linked unless asked for, so a long block costs its length times this.
REACH = 2000

#: An interval's weight is its variants in these units, and one for each step of its length.
UNIT = 1_000_000


def block_links(common: DataFrame, independent: DataFrame, cutoff: float, reach: int | None) -> tuple[DataFrame, DataFrame]:
    """``chrom, block_left, i, j`` linked within an independent block, and ``chrom, c_idx, block_left`` of all variants."""
    parts = independent.select("chrom", F.col("left_c").alias("left_idx"), F.col("right_c").alias("right_idx"), F.col("left_c").alias("block_ord"))
    placed = variant_blocks(common.select("chrom", F.col("c_idx").alias("var_idx")), parts)
    placed = written(placed.select("chrom", F.col("var_idx").alias("c_idx"), F.col("block_ord").alias("block_left")), "placed")
    longest = independent.agg(F.max(F.col("right_c") - F.col("left_c")).alias("n")).first()["n"] or 0
    window = max(1, longest if reach is None else min(reach, longest))
    edges = ld_edges(common, cutoff * cutoff, window).select("chrom", "i", "j")
    for end in ("i", "j"):
        edges = edges.join(placed.select("chrom", F.col("c_idx").alias(end), F.col("block_left").alias(f"block_{end}")), ["chrom", end])
    return edges.where("block_i = block_j").select("chrom", F.col("block_i").alias("block_left"), "i", "j"), placed


def dense_stretches(links: DataFrame, density: float = 0.5) -> DataFrame:
    """``chrom, block_left, i, j, weight``: linked ends with at least ``density`` of all pairs between them linked."""
    # For each right end the left variants from its farthest link on; each needs its links up to that end.
    firsts = links.groupBy("chrom", "block_left", "j").agg(F.min("i").alias("first"))
    grid = firsts.select("chrom", "block_left", "j", F.explode(F.sequence("first", F.col("j") - 1)).alias("i"))
    marked = grid.join(links.withColumn("link", F.lit(1)), ["chrom", "block_left", "i", "j"], "left").withColumn("link", F.coalesce("link", F.lit(0)))
    upto = F.sum("link").over(Window.partitionBy("chrom", "block_left", "i").orderBy("j"))
    marked = marked.withColumn("upto", upto)
    inside = F.sum("upto").over(Window.partitionBy("chrom", "block_left", "j").orderBy(F.desc("i")))
    size = (F.col("j") - F.col("i") + 1).cast("long")
    found = marked.withColumn("inside", inside).where((F.col("link") == 1) & (F.col("inside") >= density * size * (size - 1) / 2))
    return found.select("chrom", "block_left", "i", "j", (size * UNIT + size - 1).alias("weight"))


def best_disjoint(stretches: DataFrame) -> DataFrame:
    """``chrom, block_left, i, j`` of the disjoint stretches of largest total weight; of equal choices the shorter last one."""
    rows = stretches.repartition("chrom", "block_left").sortWithinPartitions("chrom", "block_left", "j", F.desc("i")).select("chrom", "block_left", "i", "j", "weight")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ends, best, starts = None, [], [], []

        def chosen() -> pa.RecordBatch:
            out, at = [], len(ends)
            while at:
                at -= 1
                out.append((*block, starts[at], ends[at]))
                at = bisect_left(ends, starts[at], 0, at)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["chrom", "block_left", "i", "j"])

        for batch in batches:
            for chrom, left, i, j, weight in zip(*(c.to_pylist() for c in batch.columns)):
                if (chrom, left) != block:
                    if block is not None:
                        yield chosen()
                    block, ends, best, starts = (chrom, left), [], [], []
                before = bisect_left(ends, i)
                total = weight + (best[before - 1] if before else 0)
                if best and total <= best[-1]:
                    continue
                if ends and ends[-1] == j:
                    best[-1], starts[-1] = total, i
                else:
                    ends.append(j), best.append(total), starts.append(i)
        if block is not None:
            yield chosen()

    return rows.mapInArrow(choose, "chrom string, block_left int, i int, j int")


def bigld_like(common: DataFrame, independent: DataFrame, cutoff: float = 0.5, reach: int | None = REACH, density: float = 0.5) -> DataFrame:
    """``chrom, block_ord, left_c, right_c``: blocks that tile each independent block.

    Variants up to ``reach`` apart are linked, or any of an independent block
    where it is None.
    """
    links, _ = block_links(common, independent, cutoff, reach)
    picked = best_disjoint(dense_stretches(written(links, "strong-links"), density))
    starts = picked.select("chrom", "block_left", F.col("i").alias("left_c")).unionByName(
        independent.select("chrom", F.col("left_c").alias("block_left"), F.col("left_c"))
    )
    rows = starts.distinct().join(independent.select("chrom", F.col("left_c").alias("block_left"), F.col("right_c").alias("end")), ["chrom", "block_left"])
    after = F.lead("left_c").over(Window.partitionBy("chrom", "block_left").orderBy("left_c")) - 1
    rows = rows.select("chrom", "left_c", F.coalesce(after, "end").alias("right_c"))
    return rows.withColumn("block_ord", F.row_number().over(Window.partitionBy("chrom").orderBy("left_c")) - 1)
