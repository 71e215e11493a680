"""Writers of the text outputs.  Rows are range-sorted by their ordinal; the
part files, read in name order, are the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.sources.dense import SLICE, dense_slices, write_dense


def write_lines(df: DataFrame, line: Column, order: list[str], path: str) -> None:
    df.select(*order, line.alias("value")).orderBy(*order).select("value").write.mode("overwrite").text(path)


def tab(*columns: str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])


def write_alone(alone: DataFrame, path: str) -> None:
    write_lines(alone, tab("chrom", "pos"), ["chrom_ord", "pos"], path)


def write_partition(blocks: DataFrame, path: str) -> None:
    write_lines(blocks, tab("chrom", "left_idx", "right_idx"), ["chrom", "block_ord"], path)


def write_block_names(blocks: DataFrame, path: str) -> None:
    write_lines(blocks, F.col("block"), ["chrom", "block_ord"], path)


def name_list(names: str) -> Column:
    """``['a', 'b']``; an empty list is ``[]``."""
    return F.when(F.size(names) > 0, F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))).otherwise("[]")


def haplotype_name_rows(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """``chrom, block_ord, names_line`` for every block, also those without names."""
    own = kept.groupBy("chrom", "block_ord").agg(F.array_sort(F.collect_list(F.struct("rank", "hap_name"))).alias("x"))
    rows = blocks.select("chrom", "block_ord").join(own, ["chrom", "block_ord"], "left")
    names = F.coalesce(F.transform("x", lambda s: s["hap_name"]), F.array().cast("array<string>"))
    return rows.withColumn("names", names).select("chrom", "block_ord", name_list("names").alias("names_line"))


def write_haplotype_names(blocks: DataFrame, kept: DataFrame, path: str) -> None:
    write_lines(haplotype_name_rows(blocks, kept), F.col("names_line"), ["chrom", "block_ord"], path)


def _row_cells(design: DataFrame, row: str, col: str) -> DataFrame:
    return design.select(F.col(row).cast("long").alias("row"), F.col(col).alias("col"), F.col("dose").alias("value"))


def bimbam_slices(design: DataFrame, samples: DataFrame, size: int = SLICE) -> DataFrame:
    """``row, part, text`` of ``name - - d1 d2 ...``, a row for each haplotype; zeros included."""
    haps = design.select(F.col("hap_ord").cast("long").alias("row"), "hap_name").distinct()
    rows = haps.join(F.broadcast(samples.agg((F.max("sample_idx") + 1).alias("width"))))  # one row: the number of samples
    body = dense_slices(_row_cells(design, "hap_ord", "sample_idx"), rows, F.col("width"), " ", size)
    head = haps.select("row", F.lit(-1).alias("part"), F.concat("hap_name", F.lit(" - - ")).alias("text"))
    return head.unionByName(body)


def bimbam_rows(design: DataFrame, samples: DataFrame) -> DataFrame:
    """``hap_ord, line``: whole lines, for tables whose lines fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    lines = bimbam_slices(design, samples).groupBy(F.col("row").cast("int").alias("hap_ord")).agg(parts.alias("parts"))
    return lines.select("hap_ord", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("line"))


def write_bimbam(design: DataFrame, samples: DataFrame, path: str, size: int = SLICE) -> None:
    write_dense(bimbam_slices(design, samples, size), path)


def write_design(design: DataFrame, samples: DataFrame, path: str, size: int = SLICE) -> None:
    """Header of haplotype names and one row of doses for each sample; also the header is written in slices."""
    haps = design.select("hap_ord", "hap_name").distinct()
    width = haps.count()
    rows = samples.select(F.col("sample_idx").cast("long").alias("row")).distinct()
    body = dense_slices(_row_cells(design, "sample_idx", "hap_ord"), rows, F.lit(width), "\t", size)
    name = F.when(F.col("hap_ord") > 0, F.concat(F.lit("\t"), "hap_name")).otherwise(F.col("hap_name"))
    head = haps.select(F.lit(-1).cast("long").alias("row"), F.col("hap_ord").cast("int").alias("part"), name.alias("text"))
    write_dense(head.unionByName(body), path)


def write_pip(pips: DataFrame, name: str, path: str) -> None:
    write_lines(pips, tab(name, "pip"), ["ord"], path)


def write_mean_sd(rows: DataFrame, path: str, name: str | None = None) -> None:
    """``[name] mean sd`` with six decimals."""
    line = F.format_string("%f\t%f", "mean", "sd")
    write_lines(rows, F.concat_ws("\t", name, line) if name else line, ["ord"], path)
