"""The two whole jobs: variants to design matrix, and design matrix to effects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import posterior
from strandloom.operators import bigld, blocks, clustering, haplotypes, ld, run_log, sampler
from strandloom.operators import variants as v
from strandloom.sources.scratch import written
from strandloom.sources.tables import intercept


@dataclass
class HaplotypeResult:
    alone: DataFrame
    independent: DataFrame
    fine: DataFrame
    names: DataFrame
    kept: DataFrame
    design: DataFrame


def haplotype_design(
    variants: DataFrame,
    partition: DataFrame | str = "bigld",
    r2: float = 0.1,
    clq_cut: float = 0.5,
    window: int = 100,
    clusterer: str = "xmeans",
    seed: int = 1,
    clq_reach: int | None = bigld.REACH,
) -> HaplotypeResult:
    """LD blocks, clustered haplotypes and their dosage design.

    ``partition``: "bigld", or a table of full-index blocks as
    ``read_partition`` gives it; every chromosome must be in it.  Its blocks may
    leave gaps and overlap.  Cliques link variants up to ``clq_reach`` apart, or
    any of an independent block where it is None.
    Variants, links, fine blocks and clusters are written to the shared folder
    once, as each of them is used by several of the steps.
    """
    variants = written(variants, "variants")
    common = v.common_variants(variants)
    index, last = common.select("chrom", "c_idx", "var_idx"), v.last_variant(variants)
    edges = written(ld.ld_edges(common, r2, window), "links")
    parts = ld.merge_singletons(ld.cummax_blocks(ld.reach(common, edges)))
    independent = blocks.merge_narrow(blocks.to_full_index(parts, index, last))
    if isinstance(partition, str):
        if partition != "bigld":
            raise ValueError(f"unknown partition {partition!r}")
        fine_c = bigld.bigld_like(common, parts, clq_cut, clq_reach)
        fine = blocks.merge_narrow_fine(blocks.to_full_index(fine_c, index, last), independent)
    else:
        missing = variants.select("chrom").distinct().join(partition, "chrom", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"the partition has no block of chromosome {missing[0][0]}")
        fine = partition
    fine = written(fine, "fine")
    names = blocks.block_names(variants, fine)
    strings = haplotypes.haplotype_strings(variants, fine)
    count = variants.agg(F.max(F.size("hap1")).alias("n"))
    clusters = written(clustering.cluster_haplotypes(haplotypes.distinct_haplotypes(strings, count), clusterer, seed), "clusters")
    doses = haplotypes.haplotype_doses(strings, clusters)
    kept = haplotypes.kept_haplotypes(haplotypes.rank_clusters(doses), names)
    alone = ld.alone_variants(common, edges=edges if r2 == ld.ALONE_R2 and window >= ld.ALONE_GAP else None)
    return HaplotypeResult(alone, independent, fine, names, kept, haplotypes.design(doses, kept))


@dataclass
class MappingResult:
    """``chains`` is the log of the chains: steps, kept draws, convergence, worst z of each test."""

    haplotype_pip: DataFrame
    block_pip: DataFrame
    beta: DataFrame
    alpha: DataFrame
    trace: DataFrame
    draws: DataFrame
    chains: DataFrame


def map_effects(
    design: DataFrame,
    phenotype: DataFrame,
    covariates: DataFrame | None = None,
    annotation: DataFrame | None = None,
    chains: int = 5,
    settings: sampler.Settings | None = None,
    only_converged: bool = False,
    log_folder: str | None = None,
) -> MappingResult:
    """Posterior inclusion and effects: chains in parallel, then medians over chains.

    With ``annotation`` inclusion follows a probit model of it.  Chains that end
    at ``max_iter`` without passing the Geweke test are in the medians unless
    ``only_converged``; the results say how many of the chains behind a row had
    converged (``n_converged``).  With ``log_folder`` the chains run in short jobs
    that can be watched (``run_log.run_log``) and gone on from after a stop.
    """
    covariates = intercept(phenotype) if covariates is None else covariates
    # A row a column, and read for every result: so the design is not made again for each.
    names = written(design.select("hap_ord", "hap_name").distinct().withColumn("block", haplotypes.block_of()), "names")
    firsts = names.groupBy("block").agg(F.min("hap_ord").alias("ord"))
    # One row a block: numbers in the order of the first column.
    firsts = firsts.withColumn("block_no", F.row_number().over(Window.orderBy("ord")) - 1)
    numbered = names.join(firsts, "block").select("hap_ord", "block_no")
    if log_folder is None:
        segments = sampler.sample(design, phenotype, covariates, numbered, annotation, chains, settings)
    else:
        segments = run_log.sample_in_jobs(design, phenotype, covariates, numbered, log_folder, annotation, chains, settings)
    segments = written(segments, "segments")  # so that a lost executor repeats no chain
    used = segments.where("converged") if only_converged else segments
    over = posterior.median_over_chains
    converged = sampler.chain_log(used).agg(F.sum(F.col("converged").cast("int")).alias("n_converged"))
    marked = lambda df: df.join(F.broadcast(converged))  # noqa: E731  (one row)
    columns = over(sampler.column_means(used), ["hap_ord"], ["pip", "mean", "sd"]).join(names, "hap_ord").withColumn("ord", F.col("hap_ord"))
    block_pip = over(sampler.block_means(used), ["block_no"], ["pip"]).join(firsts, "block_no").select("block", "pip", "ord")
    draws = sampler.draws(used)
    alphas = draws.select("chain", F.posexplode("alpha").alias("ord", "value"))
    alpha = over(posterior.mean_sd(alphas, ["ord"], "value"), ["ord"], ["mean", "sd"])
    stats = ["sigma_1", "sigma_e", "large_ratio", "n_gamma", "h2"]
    wide = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for k, s in enumerate(stats)]))
    rows = draws.select("chain", wide.alias("x")).select("chain", "x.ord", "x.stat", "x.value")
    trace_rows = over(posterior.mean_sd(rows, ["ord", "stat"], "value"), ["ord", "stat"], ["mean", "sd"])
    return MappingResult(
        marked(columns.select("hap_ord", "hap_name", "block", "pip", "ord")),
        marked(block_pip),
        marked(columns.select("hap_ord", "hap_name", "block", "mean", "sd", "ord")),
        marked(alpha),
        marked(trace_rows),
        draws,
        sampler.chain_log(segments),
    )
