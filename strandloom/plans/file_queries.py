"""Registered queries that go through files: everything is written as text and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import posterior
from strandloom.operators import gram, haplotypes, ld
from strandloom.operators import variants as v
from strandloom.plans import queries as core
from strandloom.plans.jobs import haplotype_design
from strandloom.plans.queries import _query
from strandloom.sources import sinks, tables
from strandloom.sources.scratch import scratch_path
from strandloom.sources.variants import fixture_variants, read_vcf


def write_fixture_vcf(spark: SparkSession, sf_dir: str) -> str:
    """The derived genotypes as VCF text, two header lines first; its path."""
    variants = fixture_variants(spark, sf_dir)
    genotypes = F.zip_with("hap1", "hap2", lambda a, b: F.concat(a.cast("string"), F.lit("|"), b.cast("string")))
    fixed = [F.lit(x) for x in ("A", "G", ".", ".", ".", "GT")]
    rows = variants.select("var_idx", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "var_id", *fixed, F.array_join(genotypes, "\t")).alias("line"))
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.size("hap1") - 1), lambda k: F.concat(F.lit("s"), k.cast("string"))), "\t")
    title = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    head = variants.where("var_idx = 0").select(
        F.explode(F.array(F.struct(F.lit(-2).alias("k"), F.lit("##fileformat=VCFv4.2").alias("line")), F.struct(F.lit(-1).alias("k"), F.concat(F.lit(title), names).alias("line")))).alias("x")
    )
    path = scratch_path(spark, "calls.vcf")
    sinks.write_lines(head.select(F.col("x.k").alias("var_idx"), "x.line").unionByName(rows), F.col("line"), ["var_idx"], path)
    return path


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return tables.numbered_lines(spark, path).select("n", F.col("value").alias("line"))


def _cell(k: int, kind: str = "double") -> Column:
    return F.split("line", "\t")[k].cast(kind)


@_query("SELECT var_idx, sample_idx, a AS hap1, b AS hap2 FROM (SELECT var_idx, sample_idx, CAST(max(allele) FILTER (hap = 0) AS BIGINT) AS a, CAST(max(allele) FILTER (hap = 1) AS BIGINT) AS b FROM calls GROUP BY ALL)")
def vcf_call_parse(spark, sf_dir):
    """Genotypes ``a|b`` of a VCF."""
    rows = read_vcf(spark, write_fixture_vcf(spark, sf_dir))
    calls = rows.select("var_idx", F.posexplode(F.arrays_zip("hap1", "hap2")).alias("sample_idx", "x"))
    return calls.select("var_idx", "sample_idx", "x.hap1", "x.hap2")


@_query("SELECT '1' AS chrom, CAST(0 AS BIGINT) AS chrom_ord, var_idx, CAST(var_idx * 100 + 100 AS BIGINT) AS pos, 'v' || var_idx AS var_id, n AS n_samples FROM spec, size")
def vcf_scan(spark, sf_dir):
    rows = read_vcf(spark, write_fixture_vcf(spark, sf_dir))
    return rows.select("chrom", "chrom_ord", "var_idx", "pos", "var_id", F.size("hap1").alias("n_samples"))


@_query("SELECT '1' AS chrom, block_ord, left_idx, right_idx FROM fine")
def partition_file_scan(spark, sf_dir):
    path = scratch_path(spark, "fine-partition")
    sinks.write_partition(core._fine(spark, sf_dir)[1], path)
    return tables.read_partition(spark, path)


@_query("""SELECT row_number() OVER (ORDER BY var_idx) - 1 AS n, '1' || chr(9) || (var_idx * 100 + 100) AS line FROM common JOIN stat USING (c_idx), size
  WHERE n * q - s * s > 0 AND c_idx NOT IN (SELECT i FROM edges WHERE j - i <= 10 UNION SELECT j FROM edges WHERE j - i <= 10)""")
def alone_snps_file(spark, sf_dir):
    path = scratch_path(spark, "alone")
    sinks.write_alone(ld.alone_variants(core._common(spark, sf_dir)), path)
    return _lines(spark, path)


@_query("SELECT block_ord AS n, block AS line FROM names")
def block_names_file(spark, sf_dir):
    path = scratch_path(spark, "block-names")
    sinks.write_block_names(core.blocks.block_names(fixture_variants(spark, sf_dir), core._partition(spark)), path)
    return _lines(spark, path)


@_query("""SELECT block_ord AS n, coalesce('[''' || string_agg(hap_name, ''', ''' ORDER BY rank) || ''']', '[]') AS line
  FROM part LEFT JOIN kept USING (block_ord) GROUP BY block_ord""")
def haplotype_names_file(spark, sf_dir):
    path = scratch_path(spark, "haplotype-names")
    sinks.write_haplotype_names(core._partition(spark), core._design(spark, sf_dir)[1], path)
    return _lines(spark, path)


@_query("""SELECT s.sample_idx, kept.hap_ord, kept.hap_name, coalesce(dose, 0) AS dose
  FROM kept CROSS JOIN (SELECT DISTINCT vec_id // 2 AS sample_idx FROM embeddings) AS s LEFT JOIN dose
  ON dose.block_ord = kept.block_ord AND dose.cluster = kept.cluster AND dose.sample_idx = s.sample_idx""")
def design_file_scan(spark, sf_dir):
    path = scratch_path(spark, "design")
    sinks.write_design(core._design(spark, sf_dir)[0], core._samples(spark, sf_dir), path)
    return tables.read_design(spark, path)


@_query("""SELECT hap_ord AS n, hap_name || ' - - ' || string_agg(CAST(coalesce(dose, 0) AS VARCHAR), ' ' ORDER BY s.sample_idx) AS line
  FROM kept CROSS JOIN (SELECT DISTINCT vec_id // 2 AS sample_idx FROM embeddings) AS s LEFT JOIN dose
  ON dose.block_ord = kept.block_ord AND dose.cluster = kept.cluster AND dose.sample_idx = s.sample_idx GROUP BY hap_ord, hap_name""")
def bimbam_file(spark, sf_dir):
    path = scratch_path(spark, "bimbam")
    sinks.write_bimbam(core._design(spark, sf_dir)[0], core._samples(spark, sf_dir), path)
    return _lines(spark, path)


@_query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS sample_idx, value AS y FROM events")
def phenotype_file_scan(spark, sf_dir):
    path = scratch_path(spark, "phenotype")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sinks.write_lines(events, F.col("value").cast("string"), ["event_id"], path)
    return tables.read_phenotype(spark, path)


def _numbers(spark, sf_dir, columns: dict[str, str], header: str | None, name: str) -> str:
    """Columns of every vector's row as a TSV in order of vec_id; its path."""
    path = scratch_path(spark, name)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[F.expr(x).cast("double").alias(c) for c, x in columns.items()])
    lines = rows.select("vec_id", sinks.tab(*columns).alias("line"))
    if header is not None:
        first = rows.agg(F.min("vec_id").alias("vec_id")).select((F.col("vec_id") - 1).alias("vec_id"), F.lit(header).alias("line"))
        lines = first.unionByName(lines)
    sinks.write_lines(lines, F.col("line"), ["vec_id"], path)
    return path


_NUMBERS = {"label": "label", "part": "vec_id / 7", "first": "embedding[0]"}
_NUMBERS_SQL = """SELECT row_number() OVER (ORDER BY vec_id, k) - 1 AS r, vec_id, k, x FROM (SELECT vec_id, unnest([0, 1, 2]) AS k,
  unnest([CAST(label AS DOUBLE), CAST(vec_id AS DOUBLE) / 7, CAST(embedding[1] AS DOUBLE)]) AS x FROM embeddings)"""


@_query(f"SELECT CAST(r // 3 AS BIGINT) AS sample_idx, CAST(k AS BIGINT) AS c_idx, x AS value FROM ({_NUMBERS_SQL})")
def covariate_file_scan(spark, sf_dir):
    return tables.read_covariates(spark, _numbers(spark, sf_dir, _NUMBERS, None, "covariates"))


@_query(f"SELECT CAST(r // 3 AS BIGINT) AS hap_ord, CAST(k AS BIGINT) AS a_idx, x AS value FROM ({_NUMBERS_SQL})")
def annotation_file_scan(spark, sf_dir):
    return tables.read_annotation(spark, _numbers(spark, sf_dir, _NUMBERS, "label\tpart\tfirst", "annotation"))


def _pip_lines(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, f"{name}-pip")
    sinks.write_pip(rows, name, path)
    return _lines(spark, path).select("n", _cell(0, "string").alias(name), F.round(_cell(1), 6).alias("pip"))


@_query("""SELECT row_number() OVER (ORDER BY block) - 1 AS n, block, round(median(pip), 6) AS pip FROM (SELECT chain, block, avg(g) AS pip FROM (
  SELECT chain, iter, block, max(gamma) AS g FROM trace GROUP BY ALL) GROUP BY ALL) GROUP BY block""")
def block_pip_file(spark, sf_dir):
    pips = posterior.median_over_chains(posterior.block_pip_any(core._trace(spark, sf_dir)), ["block"], ["pip"])
    return _pip_lines(spark, pips.withColumn("ord", F.col("block")), "block")


@_query("SELECT hap_ord AS n, 'h' || hap_ord AS hap_name, round(median(pip), 6) AS pip FROM pips GROUP BY hap_ord")
def haplotype_pip_file(spark, sf_dir):
    pips = posterior.median_over_chains(posterior.haplotype_pip(core._trace(spark, sf_dir)), ["hap_ord"], ["pip"])
    rows = pips.withColumn("ord", F.col("hap_ord")).withColumn("hap_name", F.concat(F.lit("h"), "hap_ord"))
    return _pip_lines(spark, rows, "hap_name")


@_query("""SELECT hap_ord AS n, 'h' || hap_ord AS hap_name, round(median(mean), 6) AS mean, round(median(sd), 6) AS sd FROM means GROUP BY hap_ord""")
def beta_file(spark, sf_dir):
    means = posterior.mean_sd(core._trace(spark, sf_dir), ["hap_ord"], "beta")
    rows = posterior.median_over_chains(means, ["hap_ord"], ["mean", "sd"]).withColumn("ord", F.col("hap_ord"))
    path = scratch_path(spark, "beta")
    sinks.write_mean_sd(rows.withColumn("hap_name", F.concat(F.lit("h"), "hap_ord")), path, "hap_name")
    return _lines(spark, path).select("n", _cell(0, "string").alias("hap_name"), _cell(1).alias("mean"), _cell(2).alias("sd"))


@_query("""SELECT CAST(CASE stat WHEN 'large_ratio' THEN 0 ELSE 1 END AS BIGINT) AS n, round(median(mean), 6) AS mean, round(median(sd), 6) AS sd FROM (
  SELECT stat, chain, avg(value) AS mean, stddev_pop(value) AS sd FROM (
    SELECT chain, iter, 'large_ratio' AS stat, avg(CAST(abs(beta) > CAST(0.3 AS DOUBLE) AS DOUBLE)) AS value FROM trace GROUP BY chain, iter
    UNION ALL SELECT chain, iter, 'n_gamma', CAST(sum(gamma) AS DOUBLE) FROM trace GROUP BY chain, iter) GROUP BY stat, chain) GROUP BY stat""")
def trace_file(spark, sf_dir):
    """The share of large effects and the number of columns in, a line each."""
    large = F.avg((F.abs("beta") > 0.3).cast("double")).alias("large_ratio")
    rows = core._trace(spark, sf_dir).groupBy("chain", "iter").agg(large, F.sum("gamma").cast("double").alias("n_gamma"))
    wide = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.col(s).alias("value")) for k, s in enumerate(("large_ratio", "n_gamma"))]))
    long = rows.select("chain", wide.alias("x")).select("chain", "x.ord", "x.value")
    path = scratch_path(spark, "trace")
    sinks.write_mean_sd(posterior.median_over_chains(posterior.mean_sd(long, ["ord"], "value"), ["ord"], ["mean", "sd"]), path)
    return _lines(spark, path).select("n", _cell(0).alias("mean"), _cell(1).alias("sd"))


@_query("""SELECT c_idx, sample_idx, round(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 6) AS z FROM dosage
  WINDOW w AS (PARTITION BY c_idx)""")
def standardised_dosage(spark, sf_dir):
    rows = core._common(spark, sf_dir).select("c_idx", F.posexplode("dosage").alias("sample_idx", "x"))
    stats = rows.groupBy("c_idx").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    z = v.standardize(F.col("x").cast("double"), F.col("mean"), F.col("sd"))
    return rows.join(stats, "c_idx").select("c_idx", "sample_idx", F.round(z, 6).alias("z"))


@_query("""SELECT hap_ord, round(var_pop(coalesce(dose, 0)), 6) AS variance, CAST(sum(coalesce(dose, 0) * coalesce(dose, 0)) AS BIGINT) AS norm
  FROM kept CROSS JOIN (SELECT DISTINCT vec_id // 2 AS sample_idx FROM embeddings) AS s LEFT JOIN dose
  ON dose.block_ord = kept.block_ord AND dose.cluster = kept.cluster AND dose.sample_idx = s.sample_idx GROUP BY hap_ord""")
def haplotype_variances(spark, sf_dir):
    """Variances and squared norms of the design's columns, from products with a column of ones."""
    doses = core._design(spark, sf_dir)[0].select("sample_idx", (F.col("hap_ord") + 1).alias("column"), F.col("dose").cast("double").alias("value"))
    ones = core._samples(spark, sf_dir).select("sample_idx", F.lit(0).alias("column"), F.lit(1.0).alias("value"))
    g = gram.gram(ones.unionByName(doses))
    n = g.where("j = 0").select(F.col("xy").alias("n"))
    sums = g.where("i = 0 and j > 0").select((F.col("j") - 1).alias("hap_ord"), F.col("xy").alias("s"))
    norms = g.where("i = j and j > 0").select((F.col("j") - 1).alias("hap_ord"), F.col("xy").alias("q"))
    rows = sums.join(norms, "hap_ord").join(F.broadcast(n))  # one row: the number of samples
    variance = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return rows.select("hap_ord", F.round(variance, 6).alias("variance"), F.col("q").cast("long").alias("norm"))


@_query("SELECT hap_ord, regexp_extract(hap_name, '(.*@.*)_[0-9]+', 1) AS block FROM kept")
def block_of_name(spark, sf_dir):
    return core._design(spark, sf_dir)[1].select("hap_ord", haplotypes.block_of().alias("block"))


@_query("SELECT sample_idx, hap_ord, hap_name, dose FROM design")
def haplotype_job(spark, sf_dir):
    """The whole first job: a VCF and a partition file in, the design out."""
    path = scratch_path(spark, "partition")
    sinks.write_partition(core._partition(spark), path)
    made = haplotype_design(read_vcf(spark, write_fixture_vcf(spark, sf_dir)), tables.read_partition(spark, path), clusterer="DBSCAN")
    return made.design.select("sample_idx", "hap_ord", "hap_name", "dose")


@_query()
def haplotype_job_bigld(spark, sf_dir):
    """The whole first job with its defaults: fine blocks by cliques, x-means of their haplotypes."""
    return haplotype_design(read_vcf(spark, write_fixture_vcf(spark, sf_dir))).design.select("sample_idx", "hap_ord", "hap_name", "dose")
