"""Distinct haplotypes of blocks, their clusters, doses and names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.blocks import variant_blocks


#: Samples of a slice: bounds a task's group to a block's variants times this.
SLICE_SAMPLES = 4096


def haplotype_strings(variants: DataFrame, blocks: DataFrame, slice_samples: int = SLICE_SAMPLES) -> DataFrame:
    """``chrom, block_ord, sample_idx, hap, alleles``: a row for each block and chromosome copy.

    Variants move as slices of their allele arrays, a byte an allele; a task
    turns one block's slice from variant rows into sample strings.
    """
    placed = variants.join(variant_blocks(variants, blocks), ["chrom", "var_idx"])
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("hap1"), F.lit(1)) - 1) / slice_samples).cast("int"))
    rows = placed.select("chrom", "block_ord", "var_idx", "hap1", "hap2", F.explode(starts).alias("part"))
    cut = lambda side: F.slice(side, F.col("part") * slice_samples + 1, F.lit(slice_samples)).alias(side)
    rows = rows.select("chrom", "block_ord", "part", "var_idx", cut("hap1"), cut("hap2"))

    def turn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("var_idx")
        sides = []
        for side in ("hap1", "hap2"):
            flat = table.column(side).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            letters = (flat.reshape(table.num_rows, -1).T + ord("0")).astype(np.uint8)
            sides.append(np.ascontiguousarray(letters))
        samples, width = sides[0].shape
        data = b"".join(x.tobytes() for x in sides)
        offsets = np.arange(0, 2 * samples * width + 1, width, dtype=np.int32) if width else np.zeros(2 * samples + 1, np.int32)
        strings = pa.StringArray.from_buffers(2 * samples, pa.py_buffer(offsets), pa.py_buffer(data))
        first = key[2].as_py() * slice_samples
        columns = [
            pa.array([key[0].as_py()] * (2 * samples), pa.string()),
            pa.array(np.full(2 * samples, key[1].as_py(), dtype=np.int32)),
            pa.array(np.tile(np.arange(first, first + samples, dtype=np.int32), 2)),
            pa.array(np.repeat(np.arange(2, dtype=np.int32), samples)),
            strings,
        ]
        return pa.table(columns, names=["chrom", "block_ord", "sample_idx", "hap", "alleles"])

    schema = "chrom string, block_ord int, sample_idx int, hap int, alleles string"
    return rows.groupBy("chrom", "block_ord", "part").applyInArrow(turn, schema)


def distinct_haplotypes(strings: DataFrame, count: DataFrame | None = None) -> DataFrame:
    """``chrom, block_ord, alleles, first_seen, cluster``: in order of all first copies, then all second.

    ``first_seen`` is ``hap * n + sample``; ``cluster`` is the rank of it, from 0.
    ``count`` is one row with ``n``; else it is counted from the strings.
    """
    count = strings.agg((F.max("sample_idx") + 1).alias("n")) if count is None else count
    rows = strings.join(F.broadcast(count))  # one row: the number of samples
    firsts = rows.groupBy("chrom", "block_ord", "alleles").agg(
        F.min(F.col("hap") * F.col("n") + F.col("sample_idx")).cast("long").alias("first_seen")
    )
    order = Window.partitionBy("chrom", "block_ord").orderBy("first_seen")
    return firsts.withColumn("cluster", F.row_number().over(order) - 1)


def haplotype_doses(strings: DataFrame, clusters: DataFrame) -> DataFrame:
    """``chrom, block_ord, sample_idx, cluster, dose`` (1 or 2; zeros are left out)."""
    named = strings.join(clusters.select("chrom", "block_ord", "alleles", "cluster"), ["chrom", "block_ord", "alleles"])
    return named.groupBy("chrom", "block_ord", "sample_idx", "cluster").agg(F.count("*").cast("int").alias("dose"))


def rank_clusters(doses: DataFrame) -> DataFrame:
    """``chrom, block_ord, cluster, total, rank, kept``: the reference level of each block goes.

    Ranks ascend with frequency, ties by cluster.  Of exactly two clusters the
    second is kept, as rank 1; else all but the rarest; of one, none.
    """
    totals = doses.groupBy("chrom", "block_ord", "cluster").agg(F.sum("dose").cast("long").alias("total"))
    block = Window.partitionBy("chrom", "block_ord")
    by_total = F.row_number().over(block.orderBy("total", "cluster")) - 1
    rows = totals.withColumn("n", F.count("*").over(block)).withColumn("by_total", by_total)
    by_cluster = F.row_number().over(block.orderBy("cluster")) - 1
    rank = F.when(F.col("n") == 2, by_cluster).otherwise(F.col("by_total"))
    rows = rows.withColumn("rank", rank)
    return rows.select("chrom", "block_ord", "cluster", "total", "rank", (F.col("rank") > 0).alias("kept"))


def kept_haplotypes(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """``chrom, block_ord, cluster, rank, hap_ord, hap_name`` of the columns that stay."""
    rows = ranked.where("kept").join(names.select("chrom", "block_ord", "block"), ["chrom", "block_ord"])
    rows = rows.withColumn("hap_name", F.concat("block", F.lit("_"), "rank"))
    # One row per haplotype column of the design.
    order = Window.orderBy("chrom", "block_ord", "rank")
    return rows.withColumn("hap_ord", F.row_number().over(order) - 1).select(
        "chrom", "block_ord", "cluster", "rank", "hap_ord", "hap_name"
    )


def design(doses: DataFrame, kept: DataFrame) -> DataFrame:
    """Long sparse design ``sample_idx, hap_ord, hap_name, dose``."""
    rows = doses.join(kept, ["chrom", "block_ord", "cluster"])
    return rows.select("sample_idx", "hap_ord", "hap_name", "dose")


def block_of(hap_name: str = "hap_name"):
    return F.regexp_extract(hap_name, "(.*@.*)_[0-9]+", 1)
