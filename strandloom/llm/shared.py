"""What the operators of this subpackage share: scratch tables and text batches."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one numpy step handles; bounds a worker's memory.
SLICE_CHARS = 600_000

#: Bytes of text that one task's sketch takes in; sketches that one task merges.
SKETCH_BYTES, MERGED_SKETCHES = 1 << 30, 256

#: Keys that a join sends to every task (8 bytes each, some 30 in its hash table); more are shuffled.
SENT_KEYS = 1 << 21

#: Spark's setting by which a job's shuffle files go when it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Only where that is unset (tests, one machine) a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own_scratch:
            _own_scratch.append(tempfile.mkdtemp(prefix="strandloom-"))
        base = _own_scratch[0]
    return f"{base.rstrip('/')}/strandloom/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there."""
    return written(df, name, compression)[0]


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs in here leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """As :func:`write_table`, and the table's path, for :func:`remove`."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sent(keys: DataFrame) -> DataFrame:
    """A written table of keys for a semi or anti join: sent to every task if few, so that the other side is not shuffled."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def one_each(df: DataFrame, column: str) -> bool:
    """Whether every row has a whole number of its own there."""
    if df.schema[column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    repeated = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return df.where(F.col(column).isNull()).isEmpty() and repeated.isEmpty()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns in use, as ``doc_id`` and ``text`` (null text: empty)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def text_bytes(texts: DataFrame) -> int:
    """Bytes of all of ``text``."""
    return texts.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0


def counters_log2(held: int, most: int, least: int = 16) -> int:
    """For a sketch of the runs of words of ``held`` bytes: two counters a run or more, as a power of two, up to ``most``."""
    return min(most, max(least, (held // 3).bit_length()))


def sketch_tasks(spark: SparkSession, held: int) -> int:
    """Tasks that keep a sketch each: a few for each core, and more where one would read over ``SKETCH_BYTES``.

    So neither a cluster whose executors have yet to come nor a lost executor
    leaves one task with more than that.
    """
    return max(8 * spark.sparkContext.defaultParallelism, -(-held // SKETCH_BYTES))


def quoted(name: str) -> str:
    """A column's name as one part, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def with_rest(docs: DataFrame, first: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Columns ``first`` and, as one struct ``rest``, all others: no name of theirs can clash."""
    others = [F.col(quoted(c)).alias(f"_{k}") for k, c in enumerate(c for c in docs.columns if c not in first)]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("_0"))
    return docs.select(*[F.col(quoted(c)).alias(c) for c in first], rest.alias("rest"))


def without_rest(df: DataFrame, columns: list[str], first: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``columns`` in their order, from ``first`` and the struct of :func:`with_rest`."""
    place = {c: f"rest._{k}" for k, c in enumerate(c for c in columns if c not in first)}
    return df.select(*[F.col(place.get(c, c)).alias(c) for c in columns])


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` characters; a longer text has its own."""
    begin, chars = 0, 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= limit:
            yield slice(begin, k + 1)
            begin, chars = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def batch_slices(batch: pa.RecordBatch, column: int | str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, made without copies."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, np.cumsum(sizes)
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = min(batch.num_rows, int(np.searchsorted(total, before + limit)) + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def free_worker() -> None:
    """Give back what earlier tasks left in this reused Python worker.

    Called where a task is about to hold a sketch: caches of encoders, Python's
    garbage and Arrow's spare pages go first.
    """
    library = sys.modules.get("tokenizers")
    if library is not None:
        library.__dict__.pop("_unit_encoders", None)
    gc.collect()
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; a text of ASCII alone takes the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )
