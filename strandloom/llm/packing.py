"""Sequence packing: first-fit decreasing on a tournament tree, by random groups.

Encoded documents are written to the shared folder first, so that their rows
and ids are counted before they are dealt out, and each row is told from equal
ones.  They go to groups by a hash of all that, so each group is a random sample
of bounded size, and groups are packed apart.  Within a group, ids beyond whole sequences
are packed first-fit decreasing; a tournament tree over the bins' free space
finds the first bin that fits in logarithmic time.  Bins that keep a gap are
then topped up by cutting the emptiest bins' pieces, and what is left over at
the end becomes sequences of power-of-two lengths, which need no padding.

Nulls and edge cases: a null text is empty and has only the end id; documents
without ids give no piece; repeated rows are packed each on its own; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import batch_slices, id_and_text, write_table
from strandloom.llm.unit_encoder import SLICE_BYTES, worker_encoder

Piece = tuple[int, int, int]  # row, start in that row, length

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree whose leaves are the free spaces of bins."""

    def __init__(self, bins: int, capacity: int):
        self._leaves = 1 << max(0, (bins - 1).bit_length())
        self._free = [capacity] * (2 * self._leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; the bin's number."""
        free, node = self._free, 1
        while node < self._leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        found = node - self._leaves
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``sizes`` (each in 1..capacity)."""
    if not sizes:
        return []
    tree = CapacityTree(len(sizes), capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = tree.place(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def top_up(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Fill bins from the emptiest ones; the last becomes power-of-two sequences."""

    def cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
        taken, rest, need = [], [], size
        for row, start, length in pieces:
            take = min(length, need)
            if take:
                taken.append((row, start, take))
            if take < length:
                rest.append((row, start + take, length - take))
            need -= take
        return taken, rest

    fill = lambda pieces: sum(p[2] for p in pieces)
    done = [b for b in bins if fill(b) == capacity]
    part = sorted((b for b in bins if 0 < fill(b) < capacity), key=fill, reverse=True)
    while len(part) > 1:
        taken, rest = cut(part[-1], capacity - fill(part[0]))
        part[0] = part[0] + taken
        if rest:
            part[-1] = rest
        else:
            part.pop()
        if fill(part[0]) == capacity:
            done.append(part.pop(0))
    left = part[0] if part else []
    while left:
        taken, left = cut(left, 1 << (fill(left).bit_length() - 1))
        done.append(taken)
    return done


def pack_rows(sizes: list[int], capacity: int) -> list[list[Piece]]:
    """Sequences for rows of the given numbers of ids."""
    whole = [[(r, s, capacity)] for r, n in enumerate(sizes) for s in range(0, n - capacity + 1, capacity)]
    rest = [(r, n - n % capacity, n % capacity) for r, n in enumerate(sizes) if n % capacity]
    bins = first_fit_decreasing([p[2] for p in rest], capacity)
    return whole + top_up([[rest[i] for i in b] for b in bins], capacity)


def pack(
    docs: DataFrame,
    tokenizer: str,
    keep_space: bool = True,
    end_id: int | None = 0,
    capacity: int = 1024,
    group_rows: int = 1024,
    group_ids: int = 1 << 21,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, each with its ids and its place in a sequence.

    A document of very many ids is dealt out as segments of 64 sequences.  A
    group holds about ``group_rows`` rows or ``group_ids`` ids, whichever is
    less.  One shuffle moves the ids (two bytes each where the vocabulary allows).
    """
    longest = 64 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, keep_space)
        for batch in batches:
            for part in batch_slices(batch, 1, SLICE_BYTES):
                ids, counts = encoder.encode(part.column(1))
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
                raw, out, at = ids.astype(f"<u{width}").tobytes(), [], 0
                for key, n in zip(part.column(0).to_pylist(), counts.tolist()):
                    for s in range(0, n, longest):
                        size = min(longest, n - s)
                        out.append((key, s, n, width, raw[width * (at + s) : width * (at + s + size)]))
                    at += n
                if out:
                    cols = list(zip(*out))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "doc_tokens", "width", "ids"]
                    )
            pa.default_memory_pool().release_unused()

    def pack_group(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        doc_ids, starts, tokens = (rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        widths, blobs = rows.column("width").to_pylist(), rows.column("ids").to_pylist()
        first = key[0].as_py() << 32
        out = []
        sizes = [len(b) // w for b, w in zip(blobs, widths)]
        for number, pieces in enumerate(pack_rows(sizes, capacity)):
            offset = 0
            for row, begin, length in pieces:
                width = widths[row]
                raw = np.frombuffer(blobs[row], f"<u{width}", length, begin * width).astype("<u4").tobytes()
                out.append((doc_ids[row], starts[row] + begin, length, raw, tokens[row], first + number, offset))
                offset += length
        cols = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    encoded = write_table(
        id_and_text(docs, id_col, text_col).mapInArrow(
            encode, "doc_id long, start long, doc_tokens long, width int, ids binary"
        ),
        "packing-ids",
        "snappy",
    )
    held = encoded.agg(F.count("*").alias("rows"), F.sum(F.least(F.lit(longest), F.col("doc_tokens") - F.col("start"))).alias("ids")).first()
    groups = max(1, held["rows"] // group_rows, (held["ids"] or 0) // group_ids)
    # The place of a row in the written table tells equal rows apart, however often it is read.
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id", "start", F.lit(seed)), F.lit(groups))
    return encoded.withColumn("pack_group", group).groupBy("pack_group").applyInArrow(pack_group, PIECES)
