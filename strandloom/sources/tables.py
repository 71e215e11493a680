"""Readers of the other text inputs.  Each adds the ordinal that files imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, file, begin, line``: lines with what orders them: file name, place of the split, running number.

    Spark reads the larger pieces of files first, so a running number alone
    follows the order of lines only within a piece.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")
    )
    return lines.where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())


def line_order() -> Column:
    return F.struct("file", "begin", "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``n, value``: lines that are not blank, numbered from 0 in file order.

    The pieces of files are counted, and only their counts (a row for each
    piece) are put in order; no line goes through a common task.
    """
    lines = text_lines(spark, path)
    pieces = lines.groupBy("file", "begin").agg(F.count("*").alias("lines"), F.min("line").alias("first"))
    before = F.sum("lines").over(Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("file", "begin", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(pieces, ["file", "begin"]).select((F.col("line") - F.col("first") + F.col("before")).cast("int").alias("n"), "value")


def chromosome_ordinals(keys: DataFrame) -> DataFrame:
    """``chrom, file, begin, line`` with ``chrom_ord`` (by first line) and ``var_idx`` (place within the chromosome).

    Lines are ranked within their piece of a file; what a chromosome has in the
    pieces before, in whichever files, comes from a row of counts for each
    chromosome and piece.  No window holds a chromosome, and its lines may lie
    between others and in several files.
    """
    counts = keys.groupBy("chrom", "file", "begin").agg(F.count("*").alias("lines"), F.min(line_order()).alias("first"))
    before = Window.partitionBy("chrom").orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    chroms = counts.groupBy("chrom").agg(F.min("first").alias("first"))  # a row for each chromosome
    chroms = chroms.select("chrom", (F.row_number().over(Window.orderBy("first")) - 1).alias("chrom_ord"))
    offsets = counts.select("chrom", "file", "begin", "before").join(chroms, "chrom")
    rank = F.row_number().over(Window.partitionBy("chrom", "file", "begin").orderBy("line")) - 1
    ranked = keys.withColumn("rank", rank).join(offsets, ["chrom", "file", "begin"])
    return ranked.select("chrom", "file", "begin", "line", "chrom_ord", (F.col("rank") + F.col("before")).cast("int").alias("var_idx"))


def _with_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``ord, name`` of the cells of the first line, and the other lines numbered from 0."""
    lines = numbered_lines(spark, path)
    names = lines.where("n = 0").select(F.posexplode(F.split("value", "\t")).alias("ord", "name"))
    return names, lines.where("n > 0").select((F.col("n") - 1).alias("n"), "value")


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, block_ord, left_idx, right_idx`` of a headerless TSV of full variant indices."""
    cells = F.split("value", "\t")
    rows = text_lines(spark, path).select(
        cells[0].alias("chrom"), cells[1].cast("int").alias("left_idx"), cells[2].cast("int").alias("right_idx"), line_order().alias("at")
    )
    order = Window.partitionBy("chrom").orderBy("at")
    return rows.withColumn("block_ord", F.row_number().over(order) - 1).select("chrom", "block_ord", "left_idx", "right_idx")


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """Long ``sample_idx, hap_ord, hap_name, dose`` of a TSV with a header line."""
    names, rows = _with_header(spark, path)
    cells = rows.select(F.col("n").alias("sample_idx"), F.posexplode(F.split("value", "\t")).alias("hap_ord", "dose"))
    named = cells.join(names.select(F.col("ord").alias("hap_ord"), F.col("name").alias("hap_name")), "hap_ord")
    return named.select("sample_idx", "hap_ord", "hap_name", F.col("dose").cast("tinyint").alias("dose"))


def read_phenotype(spark: SparkSession, path: str) -> DataFrame:
    """``sample_idx, y``: a number a line."""
    return numbered_lines(spark, path).select(F.col("n").alias("sample_idx"), F.trim("value").cast("double").alias("y"))


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    """``sample_idx, c_idx, value`` of a headerless TSV; no intercept is added."""
    cells = numbered_lines(spark, path).select(F.col("n").alias("sample_idx"), F.posexplode(F.split("value", "\t")).alias("c_idx", "value"))
    return cells.withColumn("value", F.col("value").cast("double"))


def intercept(samples: DataFrame) -> DataFrame:
    """The covariate table used where none is given: a column of ones."""
    return samples.select("sample_idx", F.lit(0).alias("c_idx"), F.lit(1.0).alias("value"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``hap_ord, a_idx, value`` of a TSV with a header line."""
    cells = _with_header(spark, path)[1].select(F.col("n").alias("hap_ord"), F.posexplode(F.split("value", "\t")).alias("a_idx", "value"))
    return cells.withColumn("value", F.col("value").cast("double"))
