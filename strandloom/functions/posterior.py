"""Posterior summaries of chains: inclusion probabilities, medians, Geweke z.

A trace is long: ``chain, iter, hap_ord, block, gamma, beta``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def median_over_chains(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each value's median over chains, taken on its own."""
    return rows.groupBy(*keys).agg(*[F.median(v).alias(v) for v in values])


def haplotype_pip(trace: DataFrame) -> DataFrame:
    """``chain, block, hap_ord, pip``."""
    return trace.groupBy("chain", "block", "hap_ord").agg(F.avg("gamma").alias("pip"))


def block_pip_any(trace: DataFrame) -> DataFrame:
    """``chain, block, pip``: share of iterations with any member included."""
    any_in = trace.groupBy("chain", "iter", "block").agg(F.max("gamma").alias("any"))
    return any_in.groupBy("chain", "block").agg(F.avg("any").alias("pip"))


def block_pip_noisy_or(pips: DataFrame) -> DataFrame:
    """``chain, block, pip``: 1 - product of (1 - pip), members in order."""
    members = F.array_sort(F.collect_list(F.struct("hap_ord", "pip")))
    none = F.aggregate(members, F.lit(1.0), lambda a, x: a * (1 - x["pip"]))
    return pips.groupBy("chain", "block").agg((1 - none).alias("pip"))


def block_pip_max(pips: DataFrame) -> DataFrame:
    return pips.groupBy("chain", "block").agg(F.max("pip").alias("pip"))


def mean_sd(trace: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population standard deviation, per chain."""
    return trace.groupBy("chain", *keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def block_beta_max(means: DataFrame) -> DataFrame:
    """``chain, block, beta``: the signed maximum of the members' mean effects."""
    return means.groupBy("chain", "block").agg(F.max("mean").alias("beta"))


def top_abs(trace: DataFrame, k: int = 5) -> DataFrame:
    """``chain, iter, top``: the largest absolute effects, descending (all, if fewer)."""
    sizes = F.sort_array(F.collect_list(F.abs("beta")), asc=False)
    return trace.groupBy("chain", "iter").agg(F.slice(sizes, 1, k).alias("top"))


def check_geweke(first: float, last: float, intervals: int) -> None:
    """Raise where the two parts of a series are not parts, or overlap."""
    if not (0 < first < 1 and 0 < last < 1 and first + last < 1 and intervals > 1):
        raise ValueError(f"invalid parts or intervals for the Geweke test: {first}, {last}, {intervals}")


def geweke(series: DataFrame, first: float = 0.1, last: float = 0.5, intervals: int = 20, keys: tuple[str, ...] = ("chain",)) -> DataFrame:
    """``*keys, start, z`` from ``*keys, at, value`` (at: 0, 1, ... in order in each series).

    For each start, the first ``first`` of what remains is held against the last
    ``last``.  Two constant equal slices give 0, a constant pair that differs
    gives null.  Starts per series are few; each row joins them by its keys.
    """
    check_geweke(first, last, intervals)
    sizes = series.groupBy(*keys).agg((F.max("at")).cast("int").alias("end"))
    stop = F.floor((1 - last) * F.col("end")).cast("int")
    step = F.greatest(F.floor((1 - last) * F.col("end") / (intervals - 1)).cast("int"), F.lit(1))
    starts = sizes.where(stop > 0).select(*keys, "end", F.explode(F.sequence(F.lit(0), stop - 1, step)).alias("start"))
    left = F.col("end") - F.col("start")
    bounds = starts.select(
        *keys,
        "start",
        (F.col("start") + F.floor(first * left)).cast("int").alias("first_end"),
        F.floor(F.col("end") - last * left).cast("int").alias("last_start"),
    )
    rows = series.join(F.broadcast(bounds), list(keys))  # intervals rows a series
    head = F.when((F.col("at") >= F.col("start")) & (F.col("at") < F.col("first_end")), F.col("value"))
    tail = F.when(F.col("at") >= F.col("last_start"), F.col("value"))
    stats = rows.groupBy(*keys, "start").agg(
        F.avg(head).alias("m1"), F.var_pop(head).alias("v1"), F.avg(tail).alias("m2"), F.var_pop(tail).alias("v2")
    )
    spread = F.sqrt(F.col("v1") + F.col("v2"))
    same = (spread == 0) & (F.col("m1") == F.col("m2"))
    z = F.when(same, 0.0).otherwise(F.try_divide(F.col("m1") - F.col("m2"), F.nullif(spread, F.lit(0.0))))
    return stats.select(*keys, "start", z.alias("z"))


def converged(zs: DataFrame, limit: float = 1.5) -> DataFrame:
    """``chain, worst, converged``: every z of every series of the chain is within ``limit``; a null z is not."""
    size = F.abs(F.coalesce("z", F.lit(float("inf"))))
    return zs.groupBy("chain").agg(F.max(size).alias("worst")).withColumn("converged", F.col("worst") < limit)
