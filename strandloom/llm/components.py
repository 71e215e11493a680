"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step (Kiveris et al., 2014) over a > b edges.

    Minima come from a partially aggregated group-by; a hot node's edges meet
    its one minimum in a join whose large side can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("least"))
    told = both.join(least, "a")
    if large:
        out = told.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = told.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of an edge ``a, b``.

    Large-star and small-star steps alternate until no edge changes; each round
    is written to the shared folder, so lineage stays short.  Self loops and
    repeated edges are allowed; nodes with only self loops are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    spark = edges.sparkSession
    edges, path = written(edges, name)
    told = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if told == (now["n"], now["s"]) or not now["n"]:
            break
        told = (now["n"], now["s"])
        before, (edges, path) = path, written(_star(_star(edges, True), False), name)
        remove(spark, before)
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
