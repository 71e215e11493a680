"""Allele frequency, the common-variant subset and its index map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dosage() -> Column:
    return F.zip_with("hap1", "hap2", lambda a, b: (a + b).cast("int"))


def allele_frequency(variants: DataFrame) -> DataFrame:
    """Adds ``n_alleles`` (2n), ``alt_count`` and ``af``; no shuffle, a row has all samples."""
    total = F.aggregate(F.concat("hap1", "hap2"), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = variants.withColumn("n_alleles", (F.size("hap1") * 2).cast("long")).withColumn("alt_count", total)
    return rows.withColumn("af", F.try_divide(F.col("alt_count").cast("double"), F.col("n_alleles")))


def common_variants(variants: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Variants with ``low < af < high`` and their rank ``c_idx`` within the chromosome.

    Ranks come from a window over the keys alone, so dosages are not sorted.
    """
    rows = allele_frequency(variants).where((F.col("af") > low) & (F.col("af") < high))
    order = Window.partitionBy("chrom").orderBy("var_idx")
    ranks = rows.select("chrom", "var_idx", (F.row_number().over(order) - 1).alias("c_idx"))
    return rows.join(ranks, ["chrom", "var_idx"]).withColumn("dosage", dosage()).drop("hap1", "hap2")


def common_index(variants: DataFrame) -> DataFrame:
    """``chrom, c_idx, var_idx``: common index to full index."""
    return common_variants(variants).select("chrom", "c_idx", "var_idx")


def last_variant(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom").agg(F.max("var_idx").alias("last_idx"))


def standardize(values: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd; zero where the standard deviation is."""
    return F.coalesce(F.try_divide(values - mean, F.nullif(sd, F.lit(0.0))), F.lit(0.0))
