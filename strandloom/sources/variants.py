"""Phased variants: the VCF reader and a fixture derived from embeddings.

Both give one row per variant: ``chrom, chrom_ord, var_idx, pos, var_id, hap1,
hap2``, the haplotypes being arrays of alleles in sample order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.tables import chromosome_ordinals, text_lines

#: Thresholds of the derived variants of one dimension.
THRESHOLDS = (-0.06, 0.0, 0.06, 0.30)
DIMS, GROUP_DIMS, GROUP_VARIANTS = 64, 4, 19


def read_vcf(spark: SparkSession, path: str | list[str], missing: str = "error") -> DataFrame:
    """Phased single-digit genotypes of a plain-text VCF, in file order.

    ``missing``: a genotype that is not ``digit|digit`` fails the read
    ("error"), or its variant is left out ("drop_variant").  A repeated or empty
    variant id is kept as it is; variants are told apart by ``var_idx``.
    """
    if missing not in ("error", "drop_variant"):
        raise ValueError(f"missing must be 'error' or 'drop_variant', not {missing!r}")
    lines = text_lines(spark, path)
    if not lines.where(F.col("value").startswith("#CHROM")).limit(1).count():
        raise ValueError(f"{path} has no #CHROM line")
    cells = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("#")).select("file", "begin", "line", cells.alias("cell"), F.col("value").startswith("#").alias("skip"))
    calls = F.transform(F.slice("cell", 10, F.greatest(F.size("cell") - 9, F.lit(0))), lambda g: F.split(g, ":")[0])
    rows = body.select(
        "file",
        "begin",
        "line",
        "skip",
        F.col("cell")[0].alias("chrom"),
        F.col("cell")[1].try_cast("long").alias("pos"),
        F.col("cell")[2].alias("var_id"),
        calls.alias("gt"),
    )
    phased = F.forall("gt", lambda g: g.rlike(r"^[0-9]\|[0-9]$"))
    if missing == "drop_variant":
        rows = rows.where(phased)
    else:
        # Filters may be reordered with this expression, so it passes header lines itself.
        bad = F.concat(F.lit("genotype that is not phased or not of single digits in variant "), F.col("var_id"))
        rows = rows.withColumn("gt", F.when(phased | F.col("skip"), F.col("gt")).otherwise(F.raise_error(bad).cast("array<string>")))
    allele = lambda k: F.transform("gt", lambda g: F.substring(g, k, 1).try_cast("tinyint"))
    rows = rows.select("file", "begin", "line", "chrom", "pos", "var_id", allele(1).alias("hap1"), allele(3).alias("hap2"))
    # Ordinals come from the narrow keys; genotypes are not sorted.
    order = chromosome_ordinals(rows.select("chrom", "file", "begin", "line")).select("line", "chrom_ord", "var_idx")
    return rows.join(order, "line").select("chrom", "chrom_ord", "var_idx", "pos", "var_id", "hap1", "hap2")


def fixture_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long calls ``var_idx, sample_idx, hap, allele`` of variants derived from embeddings.

    Vectors 2s and 2s + 1 are the haplotypes of sample s.  Of four neighbouring
    dimensions come 19 variants: each is over a threshold or not, and sums of
    neighbours are over zero or not, which links the variants of a group.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.expr("vec_id div 2").cast("int").alias("sample_idx"),
        F.pmod("vec_id", F.lit(2)).cast("tinyint").alias("hap"),
        F.transform("embedding", lambda x: x.cast("double")).alias("e"),
    )
    count = DIMS // GROUP_DIMS * GROUP_VARIANTS
    rows = vectors.select("sample_idx", "hap", "e", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("var_idx"))
    at = F.col("var_idx") % GROUP_VARIANTS
    kind, dim = at % 5, F.floor(F.col("var_idx") / GROUP_VARIANTS) * GROUP_DIMS + F.floor(at / 5)
    own, after = F.get("e", dim.cast("int")), F.get("e", (dim + 1).cast("int"))
    limit = F.get(F.array(*map(F.lit, THRESHOLDS)), kind)
    allele = F.when(kind < 4, own > limit).otherwise(own + after > 0).cast("tinyint")
    return rows.select("var_idx", "sample_idx", "hap", allele.alias("allele"))


def pack_variants(calls: DataFrame) -> DataFrame:
    """One row per variant from long calls of one chromosome named ``1``."""
    haps = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("hap") == h, F.struct("sample_idx", "allele")))), lambda x: x["allele"]
        ).alias(f"hap{h + 1}")
        for h in (0, 1)
    ]
    return calls.groupBy("var_idx").agg(*haps).select(
        F.lit("1").alias("chrom"),
        F.lit(0).alias("chrom_ord"),
        "var_idx",
        (F.col("var_idx") * 100 + 100).cast("long").alias("pos"),
        F.concat(F.lit("v"), F.col("var_idx")).alias("var_id"),
        "hap1",
        "hap2",
    )


def fixture_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_variants(fixture_calls(spark, sf_dir))
