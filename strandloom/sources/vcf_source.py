"""``spark.read.format("vcf")``: phased variants as a data source with its own splits.

Files are cut into byte ranges; a range begins at its first whole line and ends
with the line that crosses its end, so every line is read once.  A row knows its
place among the rows of its chromosome within the split (``local``), so global
ordinals need one row of counts for each split and chromosome, and genotypes are
never moved for them (:func:`scan_vcf`).

Columns are those of ``COLUMNS``; with ``.schema(...)`` only those named are
made, and genotypes are parsed only for them (or for ``missing``).

Options: ``missing`` is "error" (a genotype that is not ``digit|digit`` fails the
read) or "drop_variant" (its row is left out, and not counted); ``samples`` is a
comma-separated list of names to keep, in the file's order; ``splitBytes`` is the
size of a range.  Compressed files (``.gz``, ``.bz2``, ``.zst``) are one split
each.  A path is a file, a folder (hidden names left out) or several of them,
comma-separated, on any file system that pyarrow opens.  The files of a folder
may be the parts of one text, as Spark writes it: a file without a ``#CHROM``
line has the names of the last one before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandloom.sources.scratch import written

COLUMNS = {
    "chrom": ("string", pa.string()),
    "pos": ("long", pa.int64()),
    "var_id": ("string", pa.string()),
    "hap1": ("array<tinyint>", pa.list_(pa.int8())),
    "hap2": ("array<tinyint>", pa.list_(pa.int8())),
    "split": ("int", pa.int32()),
    "local": ("int", pa.int32()),
}
FIXED_CELLS, BATCH_BYTES, COMPRESSED = 9, 4 << 20, (".gz", ".bz2", ".zst")


@dataclass
class Split(InputPartition):
    number: int
    path: str
    begin: int
    end: int | None  # none: to the end of a compressed file
    head: str | None  # the file with the names of its samples


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[list[tuple[str, int]]]:
    """Names and sizes of the files of each file or folder of a path, in order of their names."""
    out = []
    for part in path.split(","):
        system, name = opened(part)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(part)
        prefix = part[: len(part) - len(name)] if part.endswith(name) else ""
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name))
        out.append(sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and (f is info or f.base_name[0] not in "._")))
    return out


def lines_of(path: str, begin: int, end: int | None) -> Iterator[bytes]:
    """Whole lines that begin in ``[begin, end)``."""
    system, name = opened(path)
    with system.open_input_stream(name) if end is None else system.open_input_file(name) as stream:
        at, block = begin, b""
        if begin:
            # To the first line end at begin - 1 or after; a range within a line reads itself and no more.
            stream.seek(begin - 1)
            at = begin - 1
            while True:
                block = stream.read(min(BATCH_BYTES, end - 1 - at))
                if not block:
                    return
                cut = block.find(b"\n") + 1
                at += cut or len(block)
                if cut:
                    block = block[cut:]
                    break
        held: list[bytes] = []  # pieces of a line without its end
        while True:
            *lines, last = block.split(b"\n")
            for line in lines:
                if held:
                    line, held = b"".join([*held, line]), []
                if end is not None and at >= end:
                    return
                yield line.rstrip(b"\r")
                at += len(line) + 1
            if last:
                held.append(last)
            if end is not None and at >= end:
                return
            block = stream.read(BATCH_BYTES)
            if not block:
                break
        if held:
            yield b"".join(held).rstrip(b"\r")


def sample_names(path: str) -> list[str] | None:
    """The names of the ``#CHROM`` line, which stands before all variants; none where there is no such line."""
    for line in lines_of(path, 0, None):
        if line.startswith(b"#CHROM"):
            return line.decode().split("\t")[FIXED_CELLS:]
        if line and not line.startswith(b"#"):
            break
    return None


def alleles(calls: bytes, count: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Both alleles of each sample, or none where a call is not ``digit|digit``."""
    if len(calls) != 4 * count - 1:  # calls with further fields, or bad ones
        cells = [c.split(b":", 1)[0] for c in calls.split(b"\t")] if calls else []
        if len(cells) != count or any(len(c) != 3 for c in cells):
            return None
        calls = b"\t".join(cells)
    codes = np.frombuffer(calls + b"\t", dtype=np.uint8).reshape(-1, 4)
    both = codes[:, (0, 2)] - np.uint8(ord("0"))
    fine = (both <= 9).all() and (codes[:, 1] == ord("|")).all() and (codes[:, 3] == ord("\t")).all()
    return (both[:, 0].astype(np.int8), both[:, 1].astype(np.int8)) if fine else None


class VcfReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]):
        self.columns, self.path = columns, options["path"]
        self.missing, self.split_bytes = options.get("missing", "error"), int(options.get("splitbytes", 64 << 20))
        self.samples = [s for s in options.get("samples", "").split(",") if s]
        if self.missing not in ("error", "drop_variant"):
            raise ValueError(f"missing must be 'error' or 'drop_variant', not {self.missing!r}")
        unknown = [c for c in columns if c not in COLUMNS]
        if unknown or self.split_bytes < 1:
            raise ValueError(f"a vcf has no column {unknown[0]!r}" if unknown else "splitBytes must be at least 1")

    def partitions(self) -> list[Split]:
        out: list[Split] = []
        for files in files_of(self.path):
            head = None
            for name, size in files:
                names = sample_names(name)
                if names is not None:
                    head = name
                    unknown = set(self.samples) - set(names)
                    if unknown:
                        raise ValueError(f"{name} has no sample {sorted(unknown)[0]!r}")
                ranges = [(0, None)] if name.endswith(COMPRESSED) else [(b, min(size, b + self.split_bytes)) for b in range(0, size, self.split_bytes)]
                for begin, end in ranges:
                    out.append(Split(len(out), name, begin, end, head))
            if files and head is None:
                raise ValueError(f"{files[0][0]} has no #CHROM line")
        for k, split in enumerate(out):
            split.value = k
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        names: list[str] | None = None  # read with the first variant
        kept = None
        parse = self.missing == "drop_variant" or "hap1" in self.columns or "hap2" in self.columns
        seen: dict[bytes, int] = {}
        rows: list[dict] = []
        held = 0
        for line in lines_of(split.path, split.begin, split.end):
            if not line or line.startswith(b"#"):
                continue
            if split.head is None:
                raise ValueError(f"{split.path} has variants before a #CHROM line")
            cells = line.split(b"\t", FIXED_CELLS)
            both = None
            if parse:
                if names is None:
                    names = sample_names(split.head) or []
                    if self.samples:
                        wanted = set(self.samples)
                        kept = np.array([k for k, n in enumerate(names) if n in wanted], dtype=np.int64)
                both = alleles(cells[FIXED_CELLS] if len(cells) > FIXED_CELLS else b"", len(names)) if names else (np.zeros(0, np.int8),) * 2
                if both is None:
                    if self.missing == "error":
                        raise ValueError(f"genotype that is not phased or not of single digits in variant {cells[2].decode()}")
                    continue
                both = both if kept is None else (both[0][kept], both[1][kept])
            local = seen.get(cells[0], 0)
            seen[cells[0]] = local + 1
            rows.append({"chrom": cells[0].decode(), "pos": int(cells[1]) if cells[1].isdigit() else None, "var_id": cells[2].decode(), "both": both, "split": split.number, "local": local})
            held += len(line)
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        arrays = []
        for name in self.columns:
            if name in ("hap1", "hap2"):
                sides = [r["both"][name == "hap2"] for r in rows]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sides])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sides))))
            else:
                arrays.append(pa.array([r[name] for r in rows], COLUMNS[name][1]))
        return pa.RecordBatch.from_arrays(arrays, names=self.columns)


class VcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return ", ".join(f"{c} {kind}" for c, (kind, _) in COLUMNS.items())

    def reader(self, schema: StructType) -> VcfReader:
        return VcfReader([f.name for f in schema.fields], {k.lower(): v for k, v in self.options.items()})


def scan_vcf(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of ``read_vcf`` through the source: ``chrom, chrom_ord, var_idx, pos, var_id, hap1, hap2``.

    Ordinals are a split's ``local`` numbers and what the splits before it have:
    a second, narrow read that parses no genotypes (but to find rows to drop).
    """
    spark.dataSource.register(VcfSource)
    source = lambda *columns: spark.read.format("vcf").options(**options).schema(", ".join(f"{c} {COLUMNS[c][0]}" for c in columns)).load(path)
    counts = source("chrom", "split").groupBy("chrom", "split").agg(F.count("*").alias("n"))
    rank = F.struct("split", "first")
    firsts = source("chrom", "split", "local").withColumn("at", F.monotonically_increasing_id()).where("local = 0").groupBy("chrom").agg(F.min(F.struct("split", F.col("at").alias("first"))).alias("head"))
    firsts = firsts.select("chrom", "head.*").withColumn("chrom_ord", F.row_number().over(Window.orderBy(rank)) - 1)  # a row for each chromosome
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chrom").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).join(firsts.select("chrom", "chrom_ord"), "chrom").select("chrom", "split", "before", "chrom_ord")
    offsets = written(offsets, "splits")  # its size is known, so it is broadcast where it is small
    rows = source("chrom", "pos", "var_id", "hap1", "hap2", "split", "local").join(offsets, ["chrom", "split"])
    return rows.select("chrom", "chrom_ord", (F.col("local") + F.col("before")).cast("int").alias("var_idx"), "pos", "var_id", "hap1", "hap2")
