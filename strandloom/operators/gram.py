"""Gram matrix of a long sparse design: one pass, partial sums of column tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.scratch import written

#: Columns of a tile, and numbers of the dense slice of samples that a task holds.
TILE, SLICE_NUMBERS = 512, 1 << 24


def gram(long: DataFrame, tile: int = TILE, slice_numbers: int = SLICE_NUMBERS) -> DataFrame:
    """``i, j, xy`` (i <= j) from ``sample_idx, column, value``: sums over samples.

    Rows of a sample meet once.  A task takes slices of samples, dense within
    the columns that occur in them, and adds up one pair of column tiles after
    the other, so it holds a slice and the tiles' sums; where these would be
    more than ``slice_numbers`` they are sent on after each slice.  Columns
    never met together are left out.
    """
    rows = long.groupBy("sample_idx").agg(F.collect_list("column").alias("cols"), F.collect_list("value").alias("vals"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (a, b), block in held.items():
                i, j = np.nonzero(block)
                i, j, xy = i + a * tile, j + b * tile, block[i, j]
                keep = i <= j
                columns = [pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(xy[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "xy"])
            held.clear()

        for batch in batches:
            at = 0
            offsets = batch.column(0).offsets.to_numpy()
            cols_of, vals_of = batch.column(0).values.to_numpy(), batch.column(1).values.to_numpy()
            width = (int(cols_of.max()) // tile + 1) * tile if len(cols_of) else tile
            step = max(1, min(4096, slice_numbers // width))  # samples of a slice
            while at < batch.num_rows:
                end = min(batch.num_rows, at + step)
                cols, vals = cols_of[offsets[at] : offsets[end]], vals_of[offsets[at] : offsets[end]]
                sample = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
                order = np.argsort(cols // tile, kind="stable")
                cols, vals, sample = cols[order], vals[order], sample[order]
                tiles, starts = np.unique(cols // tile, return_index=True)
                dense = {}
                for number, first, last in zip(tiles.tolist(), starts, [*starts[1:], len(cols)]):
                    dense[number] = np.zeros((end - at, tile))
                    dense[number][sample[first:last], cols[first:last] - number * tile] = vals[first:last]
                for a in dense:
                    for b in dense:
                        if a <= b:
                            made = dense[a].T @ dense[b]
                            held[a, b] = held[a, b] + made if (a, b) in held else made
                            if len(held) * tile * tile > slice_numbers:
                                yield from flush()
                at = end
        yield from flush()

    parts = rows.select("cols", "vals").mapInArrow(sums, "i int, j int, xy double")
    return parts.groupBy("i", "j").agg(F.sum("xy").alias("xy"))


def dense_matrix(i: np.ndarray, j: np.ndarray, xy: np.ndarray, size: int) -> np.ndarray:
    """The whole symmetric matrix."""
    out = np.zeros((size, size))
    out[i, j] = xy
    out[j, i] = xy
    return out


#: Samples of a block of a tile: with ``TILE`` columns a dense block is 4 MB.
BLOCK_SAMPLES, GROUP_BLOCKS = 1024, 64

TILES = "a int, b int, sums binary"


def gram_tiles(long: DataFrame, tile: int = TILE, block_samples: int = BLOCK_SAMPLES, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Stored tiles ``a, b, sums`` (a <= b) of the products of all columns, from ``sample_idx, column, value``.

    ``sums`` holds ``tile * tile`` numbers, row by row.  The design is cut in
    both directions: a block has the cells of ``block_samples`` samples and one
    tile of columns.  The key of the work is a pair of tiles; blocks reach it
    sorted by samples, and a task holds two blocks and one tile of sums, however
    many columns or samples there are.  A pair's samples are taken in groups of
    ``group_blocks`` blocks, whose sums are added up in a second step, so that a
    design of few tiles is spread as well.
    """
    if tile < 1 or block_samples < 1 or group_blocks < 1:
        raise ValueError("tile, block_samples and group_blocks must be at least 1")
    at = lambda column, size, name: F.expr(f"{column} div {size}").cast("int").alias(name)
    blocks = long.groupBy(at("sample_idx", block_samples, "block"), at("column", tile, "tile")).agg(
        F.collect_list((F.col("sample_idx") % block_samples).cast("int")).alias("rows"),
        F.collect_list((F.col("column") % tile).cast("int")).alias("cols"),
        F.collect_list(F.col("value").cast("double")).alias("vals"),
    )
    blocks = written(blocks, "design-blocks")
    last = blocks.agg(F.max("tile").alias("last")).first()["last"]
    ends = F.lit(-1 if last is None else last)
    to_right = F.when(F.col("tile") <= ends, F.sequence(F.col("tile"), ends))
    left = blocks.select(F.col("tile").alias("a"), F.explode(to_right).alias("b"), "block", F.lit(0).alias("side"), "rows", "cols", "vals")
    right = blocks.where("tile > 0").select(F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("a"), F.col("tile").alias("b"), "block", F.lit(1).alias("side"), "rows", "cols", "vals")
    met = left.unionByName(right).withColumn("part", F.expr(f"block div {group_blocks}"))
    met = met.repartition("a", "b", "part").sortWithinPartitions("a", "b", "part", "block", "side")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, held = None, None, (None, None)
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, block, side, part = (batch.column(c)[k].as_py() for c in ("a", "b", "block", "side", "part"))
                if (a, b, part) != key:
                    if total is not None and total.any():
                        yield _tile(*key[:2], total)
                    key, total, held = (a, b, part), np.zeros((tile, tile)), (None, None)
                dense = np.zeros((block_samples, tile))
                rows, cols, vals = (batch.column(c)[k].values.to_numpy() for c in ("rows", "cols", "vals"))
                np.add.at(dense, (rows, cols), vals)
                if a == b:
                    total += dense.T @ dense
                elif side == 0:
                    held = block, dense
                elif held[0] == block:
                    total += held[1].T @ dense
        if total is not None and total.any():
            yield _tile(*key[:2], total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                sums = np.frombuffer(batch.column(2)[k].as_py()).reshape(tile, tile)
                if now != key:
                    if key is not None:
                        yield _tile(*key, total)
                    key, total = now, np.zeros((tile, tile))
                total += sums
        if key is not None:
            yield _tile(*key, total)

    parts = met.mapInArrow(products, TILES)
    return written(parts.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(added, TILES), "gram-tiles")


def _tile(a: int, b: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([sums.tobytes()])], names=["a", "b", "sums"])


def tile_entries(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """``i, j, xy`` (i <= j) of the stored tiles, without zeros."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                block = np.frombuffer(batch.column(2)[k].as_py()).reshape(tile, tile)
                i, j = np.nonzero(np.triu(block) if a == b else block)
                columns = [pa.array((i + a * tile).astype(np.int32)), pa.array((j + b * tile).astype(np.int32)), pa.array(block[i, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "xy"])

    return tiles.mapInArrow(entries, "i int, j int, xy double")
