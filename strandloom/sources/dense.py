"""Dense text rows of a sparse table: filled in slices, written by a data source with commit.

A row of text (a haplotype's doses of all samples, or a sample's doses of all
haplotypes) is cut into slices of ``SLICE`` cells.  A task fills a slice by its
positions, so the work is linear in cells and nothing holds a whole row; the
writer ``dense_text`` puts sorted slices one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from strandloom.sources.vcf_source import opened

#: Cells of a slice.
SLICE = 1 << 16


def dense_slices(cells: DataFrame, rows: DataFrame, width: Column, separator: str, size: int = SLICE) -> DataFrame:
    """``row, part, text``: all cells of each of ``rows``, those not in ``cells`` as 0.

    ``cells`` is ``row, col, value`` with values from 0 to 9; ``width`` is an
    expression over ``rows`` (``row`` and what else it has) for the number of cells.
    Slices after the first begin with the separator.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    wide = rows.select("row", width.cast("int").alias("width")).where("width > 0")
    grid = wide.select("row", "width", F.explode(F.sequence(F.lit(0), F.expr(f"(width - 1) div {size}").cast("int"))).alias("part"))
    own = cells.groupBy("row", F.expr(f"col div {size}").cast("int").alias("part")).agg(
        F.collect_list((F.col("col") % size).cast("int")).alias("at"), F.collect_list(F.col("value").cast("tinyint")).alias("value")
    )
    length = F.least(F.col("width") - F.col("part") * size, F.lit(size)).cast("int")
    joined = grid.join(own, ["row", "part"], "left").select("row", "part", length.alias("length"), "at", "value")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, lengths = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            texts = []
            for k, length in enumerate(lengths):
                text = np.full(2 * length, ord(separator), dtype=np.uint8)
                text[1::2] = ord("0")
                if batch.column(3)[k].is_valid:
                    values = batch.column(4)[k].values.to_numpy()
                    if ((values < 0) | (values > 9)).any():
                        raise ValueError("a cell is not a single digit")
                    text[2 * batch.column(3)[k].values.to_numpy() + 1] = values.astype(np.uint8) + ord("0")
                texts.append(text[(parts[k].as_py() == 0) :].tobytes().decode())
            yield pa.RecordBatch.from_arrays([rows, parts, pa.array(texts, pa.string())], names=["row", "part", "text"])

    return joined.mapInArrow(fill, "row long, part int, text string")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str | None  # none: the task had no rows


class DenseWriter(DataSourceArrowWriter):
    """Lines of ``row, part, text`` rows, which come sorted; a part file a task, renamed on commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        partition = TaskContext.get().partitionId()
        system, name = opened(f"{self.path}/_temporary/part-{partition:05d}-{uuid.uuid4().hex}")
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        now = None
        with system.open_output_stream(name) as out:
            for batch in batches:
                rows, texts = batch.column("row").to_pylist(), batch.column("text").to_pylist()
                for row, text in zip(rows, texts):
                    if now is not None and row != now:
                        out.write(b"\n")
                    out.write(text.encode())
                    now = row
            if now is not None:
                out.write(b"\n")
        return Written(partition, name if now is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        if self.overwrite and system.get_file_info(folder).type == fs.FileType.Directory:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        for m in messages:
            if m is not None and m.path is not None:
                system.move(m.path, f"{folder}/part-{m.partition:05d}.txt")
        self._clear(system, folder)
        system.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    @staticmethod
    def _clear(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary")


class DenseText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dense_text"

    def writer(self, schema: StructType, overwrite: bool) -> DenseWriter:
        return DenseWriter(self.options["path"], overwrite)


def write_dense(slices: DataFrame, path: str) -> None:
    """Write ``row, part, text`` as lines in order of ``row``; the part files, read in name order, are the file."""
    slices.sparkSession.dataSource.register(DenseText)
    ordered = slices.select("row", "part", "text").repartitionByRange("row").sortWithinPartitions("row", "part")
    ordered.write.format("dense_text").mode("overwrite").save(path)
