"""Chains that run in short jobs, with a log that can be read meanwhile and gone on from.

A job takes every chain that has not ended a number of steps further: a task
reads the chain's last state, runs, and writes the new state with a row of the
log.  A job's rows are a table of their own, complete or not there at all, so a
lost executor repeats one job's steps, and a driver that starts anew on the same
folder goes on after the last complete job.  The draws are those of an unbroken
run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import sampler

#: A row for each chain and job.
LOG = "chain int, job int, steps bigint, kept bigint, worst_z array<double>, sigma_1 double, sigma_e double, h2 double, n_gamma bigint, converged boolean, done boolean, state binary"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _jobs(spark: SparkSession, folder: str) -> int:
    """Complete jobs in the folder."""
    count = 0
    while _exists(spark, f"{folder}/job-{count:05d}/_SUCCESS"):
        count += 1
    return count


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """``LOG`` without the states, of all complete jobs; no row before the first."""
    paths = [f"{folder}/job-{k:05d}" for k in range(_jobs(spark, folder))]
    rows = spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)
    return rows.drop("state")


def sample_in_jobs(
    design: DataFrame,
    phenotype: DataFrame,
    covariates: DataFrame,
    blocks: DataFrame,
    folder: str,
    annotation: DataFrame | None = None,
    chains: int = 5,
    settings: sampler.Settings | None = None,
    steps: int = 1000,
    most_jobs: int | None = None,
) -> DataFrame | None:
    """As :func:`strandloom.operators.sampler.sample`, ``steps`` steps a job; goes on with what is in ``folder``.

    None where ``most_jobs`` jobs have run and chains are still under way.  The
    same inputs, ``chains`` and settings belong to a folder.
    """
    if steps < 1:
        raise ValueError("steps must be at least 1")
    spark, settings = design.sparkSession, settings or sampler.Settings()
    inputs = sampler.chain_inputs(design, phenotype, covariates, blocks, annotation, settings)
    read = sampler.Inputs(None, inputs.columns, inputs.c_count, inputs.sums).read
    if not _exists(spark, f"{folder}/inputs/_SUCCESS"):
        inputs.rows.write.mode("overwrite").parquet(f"{folder}/inputs")
    rows = spark.read.schema(inputs.rows.schema).parquet(f"{folder}/inputs").withColumn("state", F.lit(None).cast("binary"))
    job, ran = _jobs(spark, folder), 0

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        chain = table.column("chain")[0].as_py()
        states = table.filter(pc.equal(table.column("kind"), "state")).column("state")
        own = sampler.Run(*sampler._with(read(table), settings, chain), states[0].as_py() if len(states) else None)
        own.advance(steps)
        c = own.c
        values = [chain, job, own.step, own.kept, own.tests, c.sigma_1, c.sigma_e, float(c.h2()), int(c.gamma.sum()), own.converged, own.done, own.state()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), *[pa.float64()] * 3, pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in LOG.split(", ")])

    while True:
        last = spark.read.schema(LOG).parquet(f"{folder}/job-{job - 1:05d}") if job else None
        open_chains = list(range(chains)) if last is None else sorted(r["chain"] for r in last.where("not done").select("chain").collect())
        if not open_chains:
            break
        if ran == most_jobs:
            return None
        copies = rows.withColumn("chain", F.explode(F.array(*map(F.lit, open_chains))))
        if last is not None:
            told = last.where("not done").select(F.lit("state").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("i", "int"), ("j", "int"), ("x", "double"))], "state", "chain")
            copies = copies.unionByName(told)
        dealt = copies.select("chain", "kind", "i", "j", "x", "state").repartitionById(chains, "chain")
        dealt.mapInArrow(advance, LOG).write.mode("overwrite").parquet(f"{folder}/job-{job:05d}")
        job, ran = job + 1, ran + 1
    ended = spark.read.schema(LOG).parquet(*[f"{folder}/job-{k:05d}" for k in range(job)]).where("done")
    ends = ended.select("chain", F.lit("state").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("i", "int"), ("j", "int"), ("x", "double"))], "state")
    copies = rows.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).select("chain", "kind", "i", "j", "x", "state")

    def told_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            chain, state = table.column("chain")[0].as_py(), table.filter(pc.equal(table.column("kind"), "state")).column("state")[0].as_py()
            yield from sampler.segment_batches(chain, sampler.Run(*sampler._with(read(table), settings, chain), state))

    return copies.unionByName(ends).repartitionById(chains, "chain").mapInArrow(told_segments, sampler.SEGMENTS)
