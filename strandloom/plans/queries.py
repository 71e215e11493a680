"""Registered queries of the operators, each with its DuckDB SQL where it has one.

The SQL of a query is a chain of named parts; each part below mirrors one
operator on genotypes derived from ``embeddings`` (all vectors).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import posterior
from strandloom.operators import bigld, blocks, clustering, gram, haplotypes, ld, sampler
from strandloom.operators import variants as v
from strandloom.plans.jobs import map_effects
from strandloom.sources import sinks
from strandloom.sources.scratch import written
from strandloom.sources.variants import fixture_variants

VARIANTS = 304

PARTS = {
    "e": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings",
    "spec": """SELECT i AS var_idx, (i % 19) % 5 AS kind, (i // 19) * 4 + (i % 19) // 5 AS dim,
      CAST([-0.06, 0.0, 0.06, 0.30] AS DOUBLE[])[(i % 19) % 5 + 1] AS t FROM range(304) AS r(i)""",
    "calls": """SELECT var_idx, vec_id // 2 AS sample_idx, vec_id % 2 AS hap,
      CAST(CASE WHEN kind < 4 THEN e[dim + 1] > t ELSE e[dim + 1] + e[dim + 2] > 0 END AS INT) AS allele FROM e, spec""",
    "size": "SELECT count(DISTINCT vec_id // 2) AS n FROM embeddings",
    "freq": """SELECT var_idx, CAST(sum(allele) AS BIGINT) AS alt_count, count(*) AS n_alleles,
      CAST(sum(allele) AS DOUBLE) / count(*) AS af FROM calls GROUP BY var_idx""",
    "common": """SELECT var_idx, row_number() OVER (ORDER BY var_idx) - 1 AS c_idx FROM freq
      WHERE af > CAST(0.02 AS DOUBLE) AND af < CAST(0.98 AS DOUBLE)""",
    "dosage": """SELECT c_idx, sample_idx, CAST(sum(allele) AS BIGINT) AS x FROM calls JOIN common USING (var_idx)
      GROUP BY c_idx, sample_idx""",
    "stat": "SELECT c_idx, sum(x) AS s, sum(x * x) AS q FROM dosage GROUP BY c_idx",
    "cross_sum": """SELECT a.c_idx AS i, b.c_idx AS j, sum(a.x * b.x) AS xy FROM dosage AS a JOIN dosage AS b
      ON a.sample_idx = b.sample_idx AND b.c_idx > a.c_idx AND b.c_idx <= a.c_idx + 100 GROUP BY ALL""",
    "all_r2": """SELECT i, j, CAST(n * xy - a.s * b.s AS DOUBLE) AS cov,
      CAST(n * a.q - a.s * a.s AS DOUBLE) * CAST(n * b.q - b.s * b.s AS DOUBLE) AS scale
      FROM cross_sum JOIN stat AS a ON a.c_idx = i JOIN stat AS b ON b.c_idx = j, size""",
    "edges": "SELECT i, j, cov * cov / scale AS r2 FROM all_r2 WHERE scale > 0 AND cov * cov / scale > CAST(0.1 AS DOUBLE)",
    "stepped": """SELECT *, CASE WHEN coalesce(j - lag(j) OVER (PARTITION BY i ORDER BY j), j - i) > 10 THEN 1 ELSE 0 END AS broken
      FROM edges""",
    "gapped": """SELECT i, j, r2 FROM (SELECT *, max(broken) OVER (PARTITION BY i ORDER BY j) AS b FROM stepped) WHERE b = 0""",
    "reach": "SELECT c_idx, coalesce(max(j), c_idx) AS reach FROM common LEFT JOIN gapped ON i = c_idx GROUP BY c_idx",
    "ends": """SELECT c_idx FROM (SELECT c_idx, max(reach) OVER (ORDER BY c_idx) AS m FROM reach) WHERE m = c_idx""",
    "runs": "SELECT lag(c_idx, 1, -1) OVER (ORDER BY c_idx) + 1 AS left_c, c_idx AS right_c FROM ends",
    "multi": """SELECT *, right_c > left_c AS m, row_number() OVER (ORDER BY left_c) AS rn, coalesce(sum(CAST(right_c > left_c AS INT))
      OVER (ORDER BY left_c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM runs""",
    "indep_c": """SELECT CAST(g - 1 AS BIGINT) AS block_ord, min(left_c) AS left_c, max(right_c) AS right_c FROM (SELECT *,
      sum(CASE WHEN rn = 1 OR (m AND bef > 0) THEN 1 ELSE 0 END) OVER (ORDER BY left_c) AS g FROM multi) GROUP BY g""",
    "indep_full": """SELECT coalesce(lag(var_idx) OVER (ORDER BY left_c) + 1, 0) AS left_idx,
      CASE WHEN lead(var_idx) OVER (ORDER BY left_c) IS NULL THEN 303 ELSE var_idx END AS right_idx
      FROM indep_c JOIN common ON right_c = c_idx""",
    "indep_prev": """SELECT *, lag(right_idx) OVER (ORDER BY left_idx) AS pr, min(left_idx) OVER () AS fl FROM indep_full""",
    "indep": """SELECT CAST(g - 1 AS BIGINT) AS block_ord, min(left_idx) AS left_idx, max(right_idx) AS right_idx FROM (SELECT *,
      sum(CASE WHEN pr IS NULL OR (right_idx - left_idx >= 10 AND pr - fl >= 10) THEN 1 ELSE 0 END) OVER (ORDER BY left_idx) AS g
      FROM indep_prev) GROUP BY g""",
    "uniform": """SELECT row_number() OVER (ORDER BY left_c) - 1 AS block_ord, left_c, right_c FROM (
      SELECT s AS left_c, CASE WHEN right_c - left_c < 5 THEN right_c ELSE least(s + 4, right_c) END AS right_c
      FROM indep_c, unnest(CASE WHEN right_c - left_c < 5 THEN [left_c] ELSE range(left_c, right_c + 1, 5) END) AS t(s))""",
    "fine_full": """SELECT coalesce(lag(var_idx) OVER (ORDER BY left_c) + 1, 0) AS left_idx,
      CASE WHEN lead(var_idx) OVER (ORDER BY left_c) IS NULL THEN 303 ELSE var_idx END AS right_idx
      FROM uniform JOIN common ON right_c = c_idx""",
    "edge": "SELECT left_idx AS x FROM indep UNION SELECT right_idx FROM indep",
    "fine_prev": """SELECT *, lag(right_idx) OVER (ORDER BY left_idx) AS pr, min(left_idx) OVER () AS fl,
      left_idx IN (SELECT x FROM edge) OR right_idx IN (SELECT x FROM edge) AS touches FROM fine_full""",
    "fine": """SELECT CAST(g - 1 AS BIGINT) AS block_ord, min(left_idx) AS left_idx, max(right_idx) AS right_idx FROM (SELECT *,
      sum(CASE WHEN pr IS NULL OR ((right_idx - left_idx >= 2 OR touches) AND pr - fl >= 2) THEN 1 ELSE 0 END)
      OVER (ORDER BY left_idx) AS g FROM fine_prev) GROUP BY g""",
    "part": """SELECT i AS block_ord, (i // 4) * 19 + (i % 4) * 5 AS left_idx,
      (i // 4) * 19 + (i % 4) * 5 + CASE WHEN i % 4 = 3 THEN 3 ELSE 4 END AS right_idx FROM range(64) AS r(i)""",
    "placed": "SELECT var_idx, block_ord FROM spec JOIN part ON var_idx BETWEEN left_idx AND right_idx",
    "strings": """SELECT block_ord, sample_idx, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY var_idx) AS alleles
      FROM calls JOIN placed USING (var_idx) GROUP BY ALL""",
    "seen": """SELECT block_ord, alleles, CAST(min(hap * n + sample_idx) AS BIGINT) AS first_seen FROM strings, size
      GROUP BY block_ord, alleles""",
    "dict": "SELECT *, row_number() OVER (PARTITION BY block_ord ORDER BY first_seen) - 1 AS cluster FROM seen",
    "dose": """SELECT block_ord, sample_idx, cluster, count(*) AS dose FROM strings JOIN dict USING (block_ord, alleles)
      GROUP BY ALL""",
    "total": "SELECT block_ord, cluster, CAST(sum(dose) AS BIGINT) AS total FROM dose GROUP BY ALL",
    "ranked": """SELECT block_ord, cluster, total, CASE WHEN count(*) OVER (PARTITION BY block_ord) = 2
      THEN row_number() OVER (PARTITION BY block_ord ORDER BY cluster) - 1
      ELSE row_number() OVER (PARTITION BY block_ord ORDER BY total, cluster) - 1 END AS rank FROM total""",
    "names": """SELECT block_ord, '1@' || (left_idx * 100 + 100) || '-' || (right_idx * 100 + 100) AS block FROM part""",
    "kept": """SELECT block_ord, cluster, rank, block || '_' || rank AS hap_name,
      row_number() OVER (ORDER BY block_ord, rank) - 1 AS hap_ord FROM ranked JOIN names USING (block_ord) WHERE rank > 0""",
    "design": "SELECT sample_idx, hap_ord, hap_name, dose FROM dose JOIN kept USING (block_ord, cluster)",
    "noise": """SELECT event_id AS sample_idx, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS noise FROM events""",
    "genetic": """SELECT sample_idx, sum(CASE hap_ord WHEN 5 THEN CAST(1.5 AS DOUBLE) WHEN 60 THEN CAST(-1.2 AS DOUBLE) ELSE 0 END * dose) AS g
      FROM design GROUP BY sample_idx""",
    "people": "SELECT DISTINCT vec_id // 2 AS sample_idx FROM embeddings",
    "wide": """SELECT sample_idx, 0 AS k, CAST(1 AS DOUBLE) AS x FROM people
      UNION ALL SELECT sample_idx, 1, coalesce(g, 0) + coalesce(noise, 0) FROM people LEFT JOIN genetic USING (sample_idx) LEFT JOIN noise USING (sample_idx)
      UNION ALL SELECT sample_idx, 2, 1 FROM people
      UNION ALL SELECT vec_id // 2, 3, CAST(label AS DOUBLE) FROM embeddings WHERE vec_id % 2 = 0
      UNION ALL SELECT sample_idx, hap_ord + 4, CAST(dose AS DOUBLE) FROM design""",
    "trace": """SELECT event_id % 5 AS chain, event_id // 5 AS iter, h AS hap_ord, '1@' || (h // 3 * 100 + 1) || '-' || (h // 3 * 100 + 100) AS block,
      CASE WHEN (user_id + 7 * h + event_id) % 11 < 3 THEN 1 ELSE 0 END AS gamma,
      ((event_id * 31 + user_id * 17 + h * 101) % 2001 - 1000) / CAST(1009 AS DOUBLE) AS beta FROM events, range(8) AS r(h)""",
    "pips": "SELECT chain, block, hap_ord, avg(gamma) AS pip FROM trace GROUP BY ALL",
    "means": "SELECT chain, block, hap_ord, avg(beta) AS mean, stddev_pop(beta) AS sd FROM trace GROUP BY ALL",
    "series": """SELECT chain, CAST(row_number() OVER (PARTITION BY chain ORDER BY iter) - 1 AS INT) AS spot, beta AS value FROM trace
      WHERE hap_ord = 0""",
    "ended": "SELECT chain, max(spot) AS fin FROM series GROUP BY chain",
    "started": """SELECT chain, fin, s AS start FROM ended,
      unnest(range(0, CAST(floor(0.5 * fin) AS INT), greatest(CAST(floor(0.5 * fin / 19) AS INT), 1))) AS t(s)""",
    "sliced": """SELECT chain, start, avg(value) FILTER (spot >= start AND spot < start + CAST(floor(CAST(0.1 AS DOUBLE) * (fin - start)) AS INT)) AS m1,
      var_pop(value) FILTER (spot >= start AND spot < start + CAST(floor(CAST(0.1 AS DOUBLE) * (fin - start)) AS INT)) AS v1,
      avg(value) FILTER (spot >= CAST(floor(fin - 0.5 * (fin - start)) AS INT)) AS m2,
      var_pop(value) FILTER (spot >= CAST(floor(fin - 0.5 * (fin - start)) AS INT)) AS v2
      FROM series JOIN started USING (chain) GROUP BY chain, start""",
}


def _sql(select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in PARTS.items()) + "\n" + select


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _longs(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Whole numbers as longs, the type that the SQL gives them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if kind in ("tinyint", "smallint", "int") else F.col(c) for c, kind in df.dtypes])

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _query(select: str | None = None):
    def add(f):
        QUERIES[f.__name__] = _longs(f)
        if select:
            ORACLES[f.__name__] = _sql(select)
        return f

    return add


def _common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.common_variants(fixture_variants(spark, sf_dir))


def _edges(spark, sf_dir) -> DataFrame:
    return ld.ld_edges(_common(spark, sf_dir))


def _independent(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    variants = fixture_variants(spark, sf_dir)
    common = v.common_variants(variants)
    return variants, common, ld.independent_blocks_common(common)


def _full(variants, common, parts) -> DataFrame:
    return blocks.to_full_index(parts, common.select("chrom", "c_idx", "var_idx"), v.last_variant(variants))


def _partition(spark: SparkSession) -> DataFrame:
    """Custom blocks: the variants of one dimension each."""
    i = F.col("id").cast("int")
    left = F.floor(i / 4) * 19 + (i % 4) * 5
    return spark.range(VARIANTS * 4 // 19).select(
        F.lit("1").alias("chrom"),
        i.alias("block_ord"),
        left.cast("int").alias("left_idx"),
        (left + F.when(i % 4 == 3, 3).otherwise(4)).cast("int").alias("right_idx"),
    )


def _strings(spark, sf_dir) -> DataFrame:
    return haplotypes.haplotype_strings(fixture_variants(spark, sf_dir), _partition(spark))


def _doses(spark, sf_dir) -> DataFrame:
    strings = _strings(spark, sf_dir)
    return haplotypes.haplotype_doses(strings, haplotypes.distinct_haplotypes(strings))


def _design(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    doses = _doses(spark, sf_dir)
    names = blocks.block_names(fixture_variants(spark, sf_dir), _partition(spark))
    kept = haplotypes.kept_haplotypes(haplotypes.rank_clusters(doses), names)
    return haplotypes.design(doses, kept), kept


def _samples(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.expr("vec_id div 2").cast("int").alias("sample_idx")).distinct()


def _trace(spark, sf_dir) -> DataFrame:
    """A deterministic trace computed from events: 5 chains, 8 haplotypes in 3 blocks."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("h"))
    block = F.floor(F.col("h") / 3) * 100
    return rows.select(
        (F.col("event_id") % 5).alias("chain"),
        F.expr("event_id div 5").alias("iter"),
        F.col("h").alias("hap_ord"),
        F.concat(F.lit("1@"), (block + 1).cast("string"), F.lit("-"), (block + 100).cast("string")).alias("block"),
        F.when((F.col("user_id") + 7 * F.col("h") + F.col("event_id")) % 11 < 3, 1).otherwise(0).alias("gamma"),
        (((F.col("event_id") * 31 + F.col("user_id") * 17 + F.col("h") * 101) % 2001 - 1000) / 1009.0).alias("beta"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@_query("SELECT var_idx, alt_count, n_alleles, af FROM freq")
def allele_freq(spark, sf_dir):
    return v.allele_frequency(fixture_variants(spark, sf_dir)).select("var_idx", "alt_count", "n_alleles", "af")


@_query("SELECT var_idx, c_idx FROM common")
def common_variants(spark, sf_dir):
    return _common(spark, sf_dir).select("var_idx", "c_idx")


@_query("SELECT i, j, r2 FROM edges")
def ld_edges_band(spark, sf_dir):
    return _edges(spark, sf_dir).select("i", "j", "r2")


@_query("SELECT i, j FROM gapped")
def ld_gap_break(spark, sf_dir):
    return ld.gap_break(_edges(spark, sf_dir)).select("i", "j")


@_query("""SELECT c_idx, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') AS neighbours FROM common LEFT JOIN (
  SELECT i AS c_idx, j AS k FROM gapped UNION SELECT j, i FROM (SELECT *, max(b) OVER (PARTITION BY j ORDER BY i DESC) AS bb FROM (
    SELECT *, CASE WHEN coalesce(lag(i) OVER (PARTITION BY j ORDER BY i DESC) - i, j - i) > 10 THEN 1 ELSE 0 END AS b FROM edges)) WHERE bb = 0
  UNION SELECT c_idx, c_idx FROM stat, size WHERE n * q - s * s > 0) USING (c_idx) GROUP BY c_idx""")
def ld_neighbour_lists(spark, sf_dir):
    common = _common(spark, sf_dir)
    lists = ld.ld_neighbours(common, ld.ld_edges(common))
    return lists.select(F.col("i").alias("c_idx"), F.array_join(F.transform("neighbours", lambda k: k.cast("string")), ",").alias("neighbours"))


@_query("SELECT c_idx, reach FROM reach")
def ld_reach(spark, sf_dir):
    common = _common(spark, sf_dir)
    return ld.reach(common, ld.ld_edges(common)).select("c_idx", "reach")


@_query("SELECT left_c, right_c FROM runs")
def ld_cummax_blocks(spark, sf_dir):
    common = _common(spark, sf_dir)
    return ld.cummax_blocks(ld.reach(common, ld.ld_edges(common))).select("left_c", "right_c")


@_query("""SELECT c_idx, var_idx, CAST(var_idx * 100 + 100 AS BIGINT) AS pos FROM common JOIN stat USING (c_idx), size WHERE n * q - s * s > 0
  AND c_idx NOT IN (SELECT i FROM edges WHERE j - i <= 10 UNION SELECT j FROM edges WHERE j - i <= 10)""")
def alone_snps(spark, sf_dir):
    return ld.alone_variants(_common(spark, sf_dir)).select("c_idx", "var_idx", "pos")


@_query("SELECT block_ord, left_c, right_c FROM indep_c")
def singleton_merge(spark, sf_dir):
    return _independent(spark, sf_dir)[2].select("block_ord", "left_c", "right_c")


@_query("SELECT block_ord, left_idx, right_idx FROM indep")
def independent_blocks(spark, sf_dir):
    return blocks.merge_narrow(_full(*_independent(spark, sf_dir))).select("block_ord", "left_idx", "right_idx")


@_query("SELECT block_ord, left_c, right_c FROM uniform")
def uniform_partition(spark, sf_dir):
    return blocks.uniform_partition(_independent(spark, sf_dir)[2], 5).select("block_ord", "left_c", "right_c")


def _fine(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    variants, common, parts = _independent(spark, sf_dir)
    independent = blocks.merge_narrow(_full(variants, common, parts))
    fine = blocks.uniform_partition(parts, 5)
    return variants, blocks.merge_narrow_fine(_full(variants, common, fine), independent)


@_query("SELECT block_ord, left_idx, right_idx FROM fine")
def fine_blocks_merge(spark, sf_dir):
    return _fine(spark, sf_dir)[1].select("block_ord", "left_idx", "right_idx")


@_query("SELECT var_idx, block_ord FROM spec JOIN fine ON var_idx BETWEEN left_idx AND right_idx")
def variant_to_block(spark, sf_dir):
    return blocks.variant_blocks(*_fine(spark, sf_dir)).select("var_idx", "block_ord")


@_query("SELECT block_ord, block FROM names")
def block_names(spark, sf_dir):
    return blocks.block_names(fixture_variants(spark, sf_dir), _partition(spark)).select("block_ord", "block")


@_query("SELECT block_ord, alleles, first_seen, cluster FROM dict")
def block_haplotypes_first_seen(spark, sf_dir):
    return haplotypes.distinct_haplotypes(_strings(spark, sf_dir)).select("block_ord", "alleles", "first_seen", "cluster")


@_query("SELECT block_ord, sample_idx, cluster, dose FROM dose")
def haplotype_dosage(spark, sf_dir):
    return _doses(spark, sf_dir).select("block_ord", "sample_idx", "cluster", "dose")


@_query("SELECT block_ord, cluster, total, rank, rank > 0 AS kept FROM ranked")
def haplotype_freq_rank_drop(spark, sf_dir):
    return haplotypes.rank_clusters(_doses(spark, sf_dir)).select("block_ord", "cluster", "total", "rank", "kept")


@_query("""SELECT hap_ord, hap_name || ' - - ' || string_agg(CAST(coalesce(dose, 0) AS VARCHAR), ' ' ORDER BY s.sample_idx) AS line
  FROM kept CROSS JOIN (SELECT DISTINCT vec_id // 2 AS sample_idx FROM embeddings) AS s LEFT JOIN dose
  ON dose.block_ord = kept.block_ord AND dose.cluster = kept.cluster AND dose.sample_idx = s.sample_idx GROUP BY hap_ord, hap_name""")
def bimbam_rows(spark, sf_dir):
    return sinks.bimbam_rows(_design(spark, sf_dir)[0], _samples(spark, sf_dir))


@_query("""SELECT block_ord, coalesce('[''' || string_agg(hap_name, ''', ''' ORDER BY rank) || ''']', '[]') AS names_line
  FROM part LEFT JOIN kept USING (block_ord) GROUP BY block_ord""")
def haplotype_name_list(spark, sf_dir):
    rows = sinks.haplotype_name_rows(_partition(spark), _design(spark, sf_dir)[1])
    return rows.select("block_ord", "names_line")


@_query("""SELECT a.hap_ord AS i, b.hap_ord AS j, CAST(sum(a.dose * b.dose) AS BIGINT) AS xy FROM design AS a JOIN design AS b
  ON a.sample_idx = b.sample_idx AND a.hap_ord <= b.hap_ord GROUP BY ALL""")
def design_gram(spark, sf_dir):
    long = _design(spark, sf_dir)[0].select("sample_idx", F.col("hap_ord").alias("column"), F.col("dose").cast("double").alias("value"))
    return gram.gram(long).select("i", "j", F.col("xy").cast("long").alias("xy"))


@_query("SELECT hap_ord, round(median(pip), 6) AS pip FROM pips GROUP BY hap_ord")
def hap_pip(spark, sf_dir):
    pips = posterior.haplotype_pip(_trace(spark, sf_dir))
    return _rounded(posterior.median_over_chains(pips, ["hap_ord"], ["pip"]), "pip")


@_query("""SELECT block, round(median(pip), 6) AS pip FROM (SELECT chain, block, avg(g) AS pip FROM (
  SELECT chain, iter, block, max(gamma) AS g FROM trace GROUP BY ALL) GROUP BY ALL) GROUP BY block""")
def block_pip_any(spark, sf_dir):
    pips = posterior.block_pip_any(_trace(spark, sf_dir))
    return _rounded(posterior.median_over_chains(pips, ["block"], ["pip"]), "pip")


@_query("SELECT chain, block, round(1 - product(1 - pip), 6) AS pip FROM pips GROUP BY ALL")
def block_pip_noisy_or(spark, sf_dir):
    return _rounded(posterior.block_pip_noisy_or(posterior.haplotype_pip(_trace(spark, sf_dir))), "pip")


@_query("SELECT chain, block, round(max(pip), 6) AS pip FROM pips GROUP BY ALL")
def block_pip_max(spark, sf_dir):
    return _rounded(posterior.block_pip_max(posterior.haplotype_pip(_trace(spark, sf_dir))), "pip")


@_query("SELECT chain, block, round(max(mean), 6) AS beta FROM means GROUP BY ALL")
def block_beta_max(spark, sf_dir):
    means = posterior.mean_sd(_trace(spark, sf_dir), ["block", "hap_ord"], "beta")
    return _rounded(posterior.block_beta_max(means), "beta")


@_query("SELECT hap_ord, round(median(mean), 6) AS mean, round(median(sd), 6) AS sd FROM means GROUP BY hap_ord")
def chain_median(spark, sf_dir):
    means = posterior.mean_sd(_trace(spark, sf_dir), ["hap_ord"], "beta")
    return _rounded(posterior.median_over_chains(means, ["hap_ord"], ["mean", "sd"]), "mean", "sd")


@_query("""SELECT chain, iter, top[1] AS b1, top[2] AS b2, top[3] AS b3, top[4] AS b4, top[5] AS b5 FROM (
  SELECT chain, iter, list(abs(beta) ORDER BY abs(beta) DESC) AS top FROM trace GROUP BY ALL)""")
def top5_abs_beta(spark, sf_dir):
    tops = posterior.top_abs(_trace(spark, sf_dir))
    return tops.select("chain", "iter", *[F.get("top", F.lit(k)).alias(f"b{k + 1}") for k in range(5)])


@_query("""SELECT chain, start, round(CASE WHEN v1 + v2 = 0 THEN CASE WHEN m1 = m2 THEN 0 END ELSE (m1 - m2) / sqrt(v1 + v2) END, 6) AS z
  FROM sliced""")
def geweke_z(spark, sf_dir):
    rows = _trace(spark, sf_dir).where("hap_ord = 0")
    order = F.row_number().over(Window.partitionBy("chain").orderBy("iter")) - 1
    series = rows.select("chain", order.alias("at"), F.col("beta").alias("value"))
    return _rounded(posterior.geweke(series), "z")


def _clustered(algorithm: str):
    @_longs
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Clusters of the haplotypes of whole linkage groups."""
        wide = spark.range(VARIANTS // 19).select(
            F.lit("1").alias("chrom"),
            F.col("id").cast("int").alias("block_ord"),
            (F.col("id") * 19).cast("int").alias("left_idx"),
            (F.col("id") * 19 + 18).cast("int").alias("right_idx"),
        )
        strings = haplotypes.haplotype_strings(fixture_variants(spark, sf_dir), wide)
        found = clustering.cluster_haplotypes(haplotypes.distinct_haplotypes(strings), algorithm)
        return found.select("block_ord", "alleles", "first_seen", "cluster")

    return run


for _name, _algorithm in (
    ("cluster_xmeans", "xmeans"),
    ("cluster_gmeans", "gmeans"),
    ("cluster_ap", "affinity_propagation"),
    ("cluster_dbscan", "DBSCAN"),
    ("cluster_knn", "KNN"),
    ("cluster_local", "local"),
    ("cluster_modularity", "modularity"),
    ("cluster_spectral", "spectral"),
):
    QUERIES[_name] = _clustered(_algorithm)


ORACLES["cluster_dbscan"] = _sql("""SELECT block_ord, alleles, first_seen, row_number() OVER (PARTITION BY block_ord ORDER BY first_seen) - 1 AS cluster FROM (
  SELECT block_ord, alleles, CAST(min(hap * n + sample_idx) AS BIGINT) AS first_seen FROM (
    SELECT CAST(var_idx // 19 AS BIGINT) AS block_ord, sample_idx, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY var_idx) AS alleles FROM calls GROUP BY ALL), size
  GROUP BY block_ord, alleles)""")


_CLIQUES = """blk AS (SELECT c_idx, left_c FROM common JOIN indep_c ON c_idx BETWEEN left_c AND right_c),
  together AS (SELECT p.left_c, a.c_idx AS i, b.c_idx AS j, sum(a.x * b.x) AS xy FROM dosage AS a JOIN dosage AS b ON a.sample_idx = b.sample_idx AND b.c_idx > a.c_idx
    JOIN blk AS p ON p.c_idx = a.c_idx JOIN blk AS q ON q.c_idx = b.c_idx AND q.left_c = p.left_c GROUP BY ALL),
  scaled AS (SELECT left_c, i, j, CAST(n * xy - a.s * b.s AS DOUBLE) AS cov, CAST(n * a.q - a.s * a.s AS DOUBLE) * CAST(n * b.q - b.s * b.s AS DOUBLE) AS scale
    FROM together JOIN stat AS a ON a.c_idx = i JOIN stat AS b ON b.c_idx = j, size),
  strong AS (SELECT left_c, i, j FROM scaled WHERE scale > 0 AND cov * cov / scale > CAST(0.25 AS DOUBLE)),
  inside AS (SELECT s.i, s.j, count(*) AS n FROM strong AS s JOIN strong AS t ON t.left_c = s.left_c AND t.i >= s.i AND t.j <= s.j GROUP BY ALL),
  cand AS (SELECT i, j, CAST((j - i + 1) * 1000000 + j - i AS BIGINT) AS w FROM inside WHERE 4 * n >= (j - i + 1) * (j - i)),
  ends_ AS (SELECT common.c_idx AS e, coalesce(list({'i': i, 'w': w}) FILTER (i IS NOT NULL), []) AS iv FROM common LEFT JOIN cand ON j = common.c_idx GROUP BY common.c_idx),
  dp(e, best) AS (SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL
    SELECT ends_.e, list_append(best, greatest(best[ends_.e + 1], coalesce(list_max(list_transform(iv, lambda x: best[x.i + 1] + x.w)), 0))) FROM dp JOIN ends_ ON ends_.e = dp.e + 1),
  total AS (SELECT e, best FROM dp ORDER BY e DESC LIMIT 1),
  trace_(spot, took) AS (SELECT e, CAST(NULL AS BIGINT) FROM total UNION ALL
    SELECT CASE WHEN best[spot + 2] = best[spot + 1] THEN spot - 1 ELSE pick - 1 END, CASE WHEN best[spot + 2] > best[spot + 1] THEN pick END FROM (
      SELECT spot, best, list_max(list_transform(list_filter(iv, lambda x: best[x.i + 1] + x.w = best[spot + 2]), lambda x: x.i)) AS pick FROM trace_ JOIN ends_ ON ends_.e = spot, total WHERE spot >= 0)),
  lefts AS (SELECT took AS left_c FROM trace_ WHERE took IS NOT NULL UNION SELECT left_c FROM indep_c)"""


@_query(f"""SELECT block_ord, left_c, right_c FROM (WITH RECURSIVE {_CLIQUES}
  SELECT row_number() OVER (ORDER BY left_c) - 1 AS block_ord, left_c, coalesce(lead(left_c) OVER (ORDER BY left_c) - 1, (SELECT max(right_c) FROM indep_c)) AS right_c FROM lefts)""")
def bigld_like_partition(spark, sf_dir):
    _, common, parts = _independent(spark, sf_dir)
    return bigld.bigld_like(common, parts).select("block_ord", "left_c", "right_c")


def simulated_study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Design, phenotype with two planted effects and noise from events, covariates.

    Design and phenotype are tables of their own: all that follows reads them many times.
    """
    design = written(_design(spark, sf_dir)[0], "design")
    dose = lambda k: F.sum(F.when(F.col("hap_ord") == k, F.col("dose")).otherwise(0))
    genetic = design.groupBy("sample_idx").agg((1.5 * dose(5) - 1.2 * dose(60)).alias("g"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("int").alias("sample_idx"), "value")
    scale = events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    noise = events.join(F.broadcast(scale)).select("sample_idx", ((F.col("value") - F.col("m")) / F.col("s")).alias("noise"))
    samples = _samples(spark, sf_dir)
    rows = samples.join(genetic, "sample_idx", "left").join(noise, "sample_idx", "left")
    phenotype = written(rows.select("sample_idx", (F.coalesce("g", F.lit(0.0)) + F.coalesce("noise", F.lit(0.0))).alias("y")), "phenotype")
    label = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 2 = 0").select(
        F.expr("vec_id div 2").cast("int").alias("sample_idx"), F.lit(1).alias("c_idx"), F.col("label").cast("double").alias("value")
    )
    ones = samples.select("sample_idx", F.lit(0).alias("c_idx"), F.lit(1.0).alias("value"))
    return design, phenotype, ones.unionByName(label)


@_query("""SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, round(sum(a.x * b.x), 4) AS xy FROM wide AS a JOIN wide AS b
  ON a.sample_idx = b.sample_idx AND a.k <= b.k GROUP BY ALL HAVING sum(a.x * b.x) <> 0""")
def study_products(spark, sf_dir):
    """Products of ones, phenotype, covariates and doses: all that the chains learn from the samples."""
    design, phenotype, covariates = simulated_study(spark, sf_dir)
    products = gram.gram(sampler.long_table(design, phenotype, covariates, 2))
    return products.where("xy <> 0").select("i", "j", F.round("xy", 4).alias("xy"))


@_query()
def gibbs_pip(spark, sf_dir):
    result = map_effects(*simulated_study(spark, sf_dir))
    return result.haplotype_pip.join(result.beta.select("hap_ord", "mean", "sd"), "hap_ord").select("hap_ord", "hap_name", "pip", "mean", "sd")


@_query()
def gibbs_block_pip(spark, sf_dir):
    return map_effects(*simulated_study(spark, sf_dir)).block_pip.select("block", "pip")


@_query()
def gibbs_annotation_pip(spark, sf_dir):
    """Inclusion under a probit model of an intercept and the block's parity."""
    design, phenotype, covariates = simulated_study(spark, sf_dir)
    haps = design.select("hap_ord", "hap_name").distinct()
    parity = (F.crc32(F.col("hap_name").cast("binary")) % 2).cast("double")
    annotation = haps.select("hap_ord", F.posexplode(F.array(F.lit(1.0), parity)).alias("a_idx", "value"))
    result = map_effects(design, phenotype, covariates, annotation)
    return result.haplotype_pip.select("hap_ord", "hap_name", "pip")
