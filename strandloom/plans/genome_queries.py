"""Registered queries over partitions that do not tile, several chromosomes and files, and all series of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import normal, posterior
from strandloom.operators import blocks, gram, haplotypes, neighbours
from strandloom.plans import queries as core
from strandloom.plans.file_queries import _cell, _lines, write_fixture_vcf
from strandloom.plans.jobs import haplotype_design
from strandloom.plans.queries import _query
from strandloom.sources import sinks, tables
from strandloom.sources.scratch import scratch_path
from strandloom.sources.variants import fixture_variants, read_vcf
from strandloom.sources.vcf_source import VcfSource, scan_vcf

#: Blocks of 6, 11 and 16 variants from every eleventh on: gaps, joints and overlaps, and an end beyond the last variant.
_LOOSE_PART = "SELECT i AS block_ord, i * 11 AS left_idx, i * 11 + 5 + 5 * (i % 3) AS right_idx FROM range(28) AS r(i)"
_LOOSE = f"""part AS ({_LOOSE_PART}),
  inside AS (SELECT var_idx, block_ord FROM spec JOIN part ON var_idx BETWEEN left_idx AND right_idx),
  rows_ AS (SELECT block_ord, sample_idx, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY var_idx) AS alleles FROM calls JOIN inside USING (var_idx) GROUP BY ALL),
  first_ AS (SELECT block_ord, alleles, CAST(min(hap * n + sample_idx) AS BIGINT) AS first_seen FROM rows_, size GROUP BY block_ord, alleles)"""


def _loose_partition(spark) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(28).select(F.lit("1").alias("chrom"), i.alias("block_ord"), (i * 11).alias("left_idx"), (i * 11 + 5 + 5 * (i % 3)).alias("right_idx"))


@_query(f"SELECT var_idx, block_ord FROM spec JOIN ({_LOOSE_PART}) ON var_idx BETWEEN left_idx AND right_idx")
def variant_to_loose_blocks(spark, sf_dir):
    """Members of blocks with gaps and overlaps: a variant is in none, one or two."""
    return blocks.variant_blocks(fixture_variants(spark, sf_dir), _loose_partition(spark), bin_size=16).select("var_idx", "block_ord")


@_query(f"SELECT block_ord, alleles, first_seen, cluster FROM (WITH {_LOOSE} SELECT *, row_number() OVER (PARTITION BY block_ord ORDER BY first_seen) - 1 AS cluster FROM first_)")
def loose_block_haplotypes(spark, sf_dir):
    strings = haplotypes.haplotype_strings(fixture_variants(spark, sf_dir), _loose_partition(spark))
    return haplotypes.distinct_haplotypes(strings).select("block_ord", "alleles", "first_seen", "cluster")


@_query(f"""SELECT sample_idx, hap_name, dose FROM (WITH {_LOOSE},
  numbered AS (SELECT *, row_number() OVER (PARTITION BY block_ord ORDER BY first_seen) - 1 AS cluster FROM first_),
  doses AS (SELECT block_ord, sample_idx, cluster, count(*) AS dose FROM rows_ JOIN numbered USING (block_ord, alleles) GROUP BY ALL),
  totals AS (SELECT block_ord, cluster, sum(dose) AS total FROM doses GROUP BY ALL),
  places AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY block_ord) = 2 THEN cluster ELSE row_number() OVER (PARTITION BY block_ord ORDER BY total, cluster) - 1 END AS rank FROM totals)
  SELECT sample_idx, '1@' || (left_idx * 100 + 100) || '-' || (least(right_idx, 303) * 100 + 100) || '_' || rank AS hap_name, dose
  FROM doses JOIN places USING (block_ord, cluster) JOIN part USING (block_ord) WHERE rank > 0)""")
def haplotype_job_loose(spark, sf_dir):
    """The whole first job on a partition file with gaps and overlaps."""
    path = scratch_path(spark, "loose-partition")
    sinks.write_partition(_loose_partition(spark), path)
    made = haplotype_design(read_vcf(spark, write_fixture_vcf(spark, sf_dir)), tables.read_partition(spark, path), clusterer="DBSCAN")
    return made.design.select("sample_idx", "hap_name", "dose")


@_query("SELECT var_idx, sample_idx, a AS hap1, b AS hap2 FROM (SELECT var_idx, sample_idx, CAST(max(allele) FILTER (hap = 0) AS BIGINT) AS a, CAST(max(allele) FILTER (hap = 1) AS BIGINT) AS b FROM calls GROUP BY ALL)")
def vcf_source_calls(spark, sf_dir):
    """Genotypes through ``format("vcf")``, files cut into several splits."""
    rows = scan_vcf(spark, write_fixture_vcf(spark, sf_dir), splitBytes=20_000)
    return rows.select("var_idx", F.posexplode(F.arrays_zip("hap1", "hap2")).alias("sample_idx", "x")).select("var_idx", "sample_idx", "x.hap1", "x.hap2")


@_query("SELECT var_idx, sample_idx // 10 AS spot, CAST(max(allele) FILTER (hap = 1) AS BIGINT) AS hap2 FROM calls WHERE sample_idx IN (10, 30) GROUP BY var_idx, sample_idx")
def vcf_source_samples(spark, sf_dir):
    """One side of two named samples: other columns and samples are not made."""
    path = write_fixture_vcf(spark, sf_dir)
    spark.dataSource.register(VcfSource)
    rows = spark.read.format("vcf").schema("pos long, hap2 array<tinyint>").option("samples", "s10,s30").load(path)
    spots = rows.select(((F.col("pos") - 100) / 100).cast("long").alias("var_idx"), F.posexplode("hap2").alias("spot", "hap2"))
    return spots.select("var_idx", (F.col("spot") * 2 + 1).alias("spot"), "hap2")


_CHROM = "CASE WHEN (var_idx * 5) % 7 < 3 THEN 'b' WHEN (var_idx * 5) % 7 < 5 THEN 'a' ELSE 'c' END"


def _many_chromosomes(spark, sf_dir) -> str:
    """The derived genotypes as two files in which the lines of three chromosomes alternate; their folder."""
    path = write_fixture_vcf(spark, sf_dir)
    lines = tables.numbered_lines(spark, path).where("n >= 2").select((F.col("n") - 2).alias("var_idx"), F.split("value", "\t", 2)[1].alias("rest"))
    head = tables.numbered_lines(spark, path).where("n < 2").select((F.col("n") - 2).alias("var_idx"), F.col("value").alias("line"))
    body = lines.select("var_idx", F.concat_ws("\t", F.expr(_CHROM), "rest").alias("line"))
    folder = scratch_path(spark, "chromosomes")
    for name, part in (("first", body.where("var_idx < 150")), ("second", body.where("var_idx >= 150"))):
        sinks.write_lines(head.unionByName(part), F.col("line"), ["var_idx"], f"{folder}-{name}")
    return f"{folder}-first,{folder}-second"


_CHROM_SQL = f"""SELECT chrom, CAST(dense_rank() OVER (ORDER BY head) - 1 AS BIGINT) AS chrom_ord, spot AS var_idx, CAST(var_idx * 100 + 100 AS BIGINT) AS pos, alleles FROM (
  SELECT *, min(var_idx) OVER (PARTITION BY chrom) AS head, row_number() OVER (PARTITION BY chrom ORDER BY var_idx) - 1 AS spot FROM (
    SELECT var_idx, {_CHROM} AS chrom, string_agg(CAST(allele AS VARCHAR), '' ORDER BY hap, sample_idx) AS alleles FROM calls GROUP BY var_idx))"""


def _called(rows: DataFrame) -> DataFrame:
    alleles = F.array_join(F.transform(F.concat("hap1", "hap2"), lambda a: a.cast("string")), "")
    return rows.select("chrom", "chrom_ord", "var_idx", "pos", alleles.alias("alleles"))


@_query(_CHROM_SQL)
def vcf_many_chromosomes(spark, sf_dir):
    """Ordinals of three chromosomes whose lines alternate, carried on from one file to the next."""
    paths = _many_chromosomes(spark, sf_dir).split(",")
    return _called(read_vcf(spark, paths))


@_query(_CHROM_SQL)
def vcf_source_chromosomes(spark, sf_dir):
    """The same through ``format("vcf")``: only counts of splits are put in order."""
    return _called(scan_vcf(spark, _many_chromosomes(spark, sf_dir), splitBytes=30_000))


@_query("""SELECT event_id, round(exp(-z * z / 2) / sqrt(2 * pi()), 9) AS density,
  round(0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k:
    exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))), 9) AS share, round(z, 7) AS point
  FROM (SELECT event_id, CAST(event_id % 1801 - 900 AS DOUBLE) / 200 + (value - avg(value) OVER ()) / stddev_pop(value) OVER () / 100 AS z FROM events)""")
def normal_functions(spark, sf_dir):
    """Density, share and, back from the share, the point, of values between about -5 and 5."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    scale = events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("event_id") % 1801 - 900).cast("double") / 200 + (F.col("value") - F.col("m")) / F.col("s") / 100
    rows = events.join(F.broadcast(scale)).select("event_id", z.alias("z"))  # one row
    # The point is found from the tail, where shares keep their digits.
    rows = rows.withColumn("tail", normal.cdf(-F.abs("z"))).withColumn("upper", -normal.ppf(F.col("tail")))
    return rows.select("event_id", F.round(normal.pdf(F.col("z")), 9).alias("density"), F.round(normal.cdf(F.col("z")), 9).alias("share"), F.round(F.signum("z") * F.col("upper"), 7).alias("point"))


_STATS = ("sigma_1", "sigma_e", "large_ratio", "n_gamma", "h2")
_VALUES = {"sigma_1": "1 + (event_id * 13 + user_id) % 997 / 1009.0D", "sigma_e": "1 + (event_id * 7 + user_id * 3) % 991 / 2003.0D"}
_ALPHAS = "((event_id * 29 + user_id * (11 + a)) % 1999 - 900) / CAST(1013 AS DOUBLE)"
_STAT_SQL = f"""SELECT chain, iter, ord, CASE ord WHEN 0 THEN s1 WHEN 1 THEN se WHEN 2 THEN ratio WHEN 3 THEN n ELSE s1 / (s1 + se) END AS value FROM (
  SELECT chain, iter, avg(CAST(abs(beta) > CAST(0.3 AS DOUBLE) AS DOUBLE)) AS ratio, CAST(sum(gamma) AS DOUBLE) AS n FROM trace GROUP BY chain, iter) JOIN (
  SELECT event_id % 5 AS chain, event_id // 5 AS iter, {_VALUES['sigma_1'].replace("1009.0D", "CAST(1009 AS DOUBLE)")} AS s1, {_VALUES['sigma_e'].replace("2003.0D", "CAST(2003 AS DOUBLE)")} AS se FROM events) USING (chain, iter), range(5) AS o(ord)"""
_ALPHA_SQL = f"SELECT event_id % 5 AS chain, event_id // 5 AS iter, a AS ord, {_ALPHAS} AS value FROM events, range(3) AS r(a)"


def _chain_stats(spark, sf_dir) -> DataFrame:
    """``chain, iter, ord, value``: the five series of the trace, computed from events."""
    large = F.avg((F.abs("beta") > 0.3).cast("double")).alias("large_ratio")
    rows = core._trace(spark, sf_dir).groupBy("chain", "iter").agg(large, F.sum("gamma").cast("double").alias("n_gamma"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("event_id") % 5).alias("chain"), F.expr("event_id div 5").alias("iter"), *[F.expr(x).cast("double").alias(s) for s, x in _VALUES.items()]
    )
    wide = rows.join(events, ["chain", "iter"]).withColumn("h2", F.col("sigma_1") / (F.col("sigma_1") + F.col("sigma_e")))
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.col(s).alias("value")) for k, s in enumerate(_STATS)]))
    return wide.select("chain", "iter", long.alias("x")).select("chain", "iter", "x.ord", "x.value")


def _chain_alphas(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("a"))
    value = ((F.col("event_id") * 29 + F.col("user_id") * (F.col("a") + 11)) % 1999 - 900) / 1013.0
    return events.select((F.col("event_id") % 5).alias("chain"), F.expr("event_id div 5").alias("iter"), F.col("a").alias("ord"), value.alias("value"))


def _mean_sd_lines(spark, rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    sinks.write_mean_sd(posterior.median_over_chains(posterior.mean_sd(rows, ["ord"], "value"), ["ord"], ["mean", "sd"]), path)
    return _lines(spark, path).select("n", _cell(0).alias("mean"), _cell(1).alias("sd"))


_LINES_SQL = "SELECT ord AS n, round(median(mean), 6) AS mean, round(median(sd), 6) AS sd FROM (SELECT ord, chain, avg(value) AS mean, stddev_pop(value) AS sd FROM ({}) GROUP BY ALL) GROUP BY ord"


@_query(_LINES_SQL.format(_STAT_SQL))
def trace_file_rows(spark, sf_dir):
    """All five lines of the trace file."""
    return _mean_sd_lines(spark, _chain_stats(spark, sf_dir), "trace-rows")


@_query(_LINES_SQL.format(_ALPHA_SQL))
def alpha_file(spark, sf_dir):
    """The file of covariate effects, a line each."""
    return _mean_sd_lines(spark, _chain_alphas(spark, sf_dir), "alpha")


_SERIES_SQL = f"""series AS (SELECT chain, 'alpha_' || ord AS name, iter, value FROM ({_ALPHA_SQL})
    UNION ALL SELECT chain, 'stat_' || ord, iter, value FROM ({_STAT_SQL}) WHERE ord IN (1, 2, 4)
    UNION ALL SELECT chain, 'top_' || k, iter, top[k + 1] FROM (SELECT chain, iter, list(abs(beta) ORDER BY abs(beta) DESC) AS top FROM trace GROUP BY ALL), range(5) AS t(k)),
  placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY chain, name ORDER BY iter) - 1 AS INT) AS spot FROM series),
  ended AS (SELECT chain, name, max(spot) AS fin FROM placed GROUP BY ALL),
  started AS (SELECT chain, name, fin, s AS start FROM ended, unnest(range(0, CAST(floor(0.5 * fin) AS INT), greatest(CAST(floor(0.5 * fin / 19) AS INT), 1))) AS t(s)),
  cut AS (SELECT chain, name, start, avg(value) FILTER (spot >= start AND spot < start + CAST(floor(CAST(0.1 AS DOUBLE) * (fin - start)) AS INT)) AS m1,
      var_pop(value) FILTER (spot >= start AND spot < start + CAST(floor(CAST(0.1 AS DOUBLE) * (fin - start)) AS INT)) AS v1,
      avg(value) FILTER (spot >= CAST(floor(fin - 0.5 * (fin - start)) AS INT)) AS m2,
      var_pop(value) FILTER (spot >= CAST(floor(fin - 0.5 * (fin - start)) AS INT)) AS v2 FROM placed JOIN started USING (chain, name) GROUP BY chain, name, start),
  z AS (SELECT chain, name, start, CASE WHEN v1 + v2 = 0 THEN CASE WHEN m1 = m2 THEN 0 END ELSE (m1 - m2) / sqrt(v1 + v2) END AS z FROM cut)"""


def _all_z(spark, sf_dir) -> DataFrame:
    """Geweke z of every series that a chain is judged by: alphas, the five largest effects, ratio, h2, sigma_e."""
    named = lambda df, name: df.select("chain", F.concat(F.lit(f"{name}_"), F.col("ord").cast("string")).alias("name"), "iter", "value")
    tops = posterior.top_abs(core._trace(spark, sf_dir)).select("chain", "iter", F.posexplode("top").alias("ord", "value"))
    series = named(_chain_alphas(spark, sf_dir), "alpha").unionByName(named(_chain_stats(spark, sf_dir).where("ord in (1, 2, 4)"), "stat")).unionByName(named(tops, "top"))
    spot = (F.row_number().over(Window.partitionBy("chain", "name").orderBy("iter")) - 1).alias("at")
    return posterior.geweke(series.select("chain", "name", spot, "value"), keys=("chain", "name"))


@_query(f"SELECT chain, name, start, z FROM (WITH {_SERIES_SQL} SELECT chain, name, start, round(z, 6) AS z FROM z)")
def geweke_all_series(spark, sf_dir):
    return core._rounded(_all_z(spark, sf_dir), "z")


@_query(f"SELECT chain, round(worst, 6) AS worst, worst < 1.5 AS converged FROM (WITH {_SERIES_SQL} SELECT chain, max(abs(coalesce(z, 'inf'::DOUBLE))) AS worst FROM z GROUP BY chain)")
def chain_convergence(spark, sf_dir):
    """Whether each chain has converged by all its series."""
    return core._rounded(posterior.converged(_all_z(spark, sf_dir)), "worst")


@_query("""SELECT a.hap_ord AS i, b.hap_ord AS j, CAST(sum(a.dose * b.dose) AS BIGINT) AS xy FROM design AS a JOIN design AS b
  ON a.sample_idx = b.sample_idx AND a.hap_ord <= b.hap_ord GROUP BY ALL""")
def design_gram_tiles(spark, sf_dir):
    """Products of the design's columns as a table of tiles, for any number of columns."""
    long = core._design(spark, sf_dir)[0].select("sample_idx", F.col("hap_ord").alias("column"), F.col("dose").cast("double").alias("value"))
    tiles = gram.gram_tiles(long, tile=64, block_samples=128, group_blocks=2)
    return gram.tile_entries(tiles, 64).select("i", "j", F.col("xy").cast("long").alias("xy"))


@_query("""SELECT block_ord, alleles, k, distance FROM (WITH rows_ AS (SELECT CAST(var_idx // 19 AS BIGINT) AS block_ord, sample_idx, hap,
    string_agg(CAST(allele AS VARCHAR), '' ORDER BY var_idx) AS alleles FROM calls GROUP BY ALL),
  haps AS (SELECT DISTINCT block_ord, alleles FROM rows_),
  sized AS (SELECT block_ord, least(greatest(count(*) // 10, 10), count(*) - 1) AS k FROM haps GROUP BY block_ord),
  apart AS (SELECT a.block_ord, a.alleles, list(hamming(a.alleles, b.alleles) ORDER BY hamming(a.alleles, b.alleles)) AS ds
    FROM haps AS a JOIN haps AS b ON a.block_ord = b.block_ord AND a.alleles <> b.alleles GROUP BY ALL)
  SELECT block_ord, alleles, k, ds[k] AS distance FROM apart JOIN sized USING (block_ord))""")
def kth_neighbour_distance(spark, sf_dir):
    """Scale of each haplotype's surroundings: the distance to its k-th nearest in the block."""
    wide = spark.range(core.VARIANTS // 19).select(
        F.lit("1").alias("chrom"), F.col("id").cast("int").alias("block_ord"), (F.col("id") * 19).cast("int").alias("left_idx"), (F.col("id") * 19 + 18).cast("int").alias("right_idx")
    )
    distinct = haplotypes.distinct_haplotypes(haplotypes.haplotype_strings(fixture_variants(spark, sf_dir), wide))
    return neighbours.kth_neighbour(distinct).select("block_ord", "alleles", "k", "distance")
