"""Substring dedup: a count-min prefilter, then exact grouping of what repeats.

Pass 1 hashes every window of ``window`` consecutive words.  Each task keeps a
count-min sketch whose counters saturate at two (two bit planes a row); scan
partitions are coalesced to a few for each core, so the number of sketches goes
with the cluster and not with the input, and they are merged block by block.  A merged counter is never below a
window's true count, so a window with a counter of one in any row is unique.
Pass 2 groups only the windows estimated to repeat, by a 96-bit fingerprint,
and finds those that do not come first.  Pass 3 removes the words they cover.

The merged sketch that tasks receive has ``depth * 2 ** (width_log2 - 3)``
bytes: the width goes with the bytes of text, up to ``most_log2`` (64 MB in all
by default; raise it where workers have the memory).  With more windows than
counters the filter lets more through, and pass 2, split by fingerprint, stays
exact.
A passage that a third of all documents holds costs pass 2 one entry for each
batch of documents, as only a batch's first occurrence goes on.

Nulls and edge cases: a null text has no words; texts shorter than a window
keep all; copies of a text in the same table lose every window but the first;
a window counts as earlier by ``(doc_id, start)``, so equal rows do not cut each
other, and rows that share a ``doc_id`` but not the text (told apart by the
text's CRC-32) are each cut at their own places; rows with a null ``doc_id`` have no place, so they are neither cut nor compared;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.hashing import WordHasher, mix, run_hashes, run_starts
from strandloom.llm.shared import MERGED_SKETCHES, SLICE_CHARS, batch_slices, counters_log2, free_worker, id_and_text, sketch_tasks, text_bytes

_BLOCK_LOG2 = 22
_REPEATED_SCHEMA = "row int, block int, windows long, seen binary, repeated binary"
_ENTRY_SCHEMA = "shard int, doc_ids array<bigint>, crcs binary, docs binary, starts binary, prints binary, later_docs binary, later_starts binary"
_PLACE_SCHEMA = "part int, doc_ids array<bigint>, crcs binary, counts binary, starts binary"


def _cells(windows: np.ndarray, row: int, width_log2: int) -> np.ndarray:
    salted = windows if row == 0 else mix(windows ^ np.uint64(0xA0761D6478BD642F * row % (1 << 64)))
    return salted >> np.uint64(64 - width_log2)


def _set_bits(plane: np.ndarray, cells: np.ndarray) -> None:
    """Set bits of sorted distinct cells in a packed plane."""
    at = (cells >> np.uint64(3)).astype(np.int64)
    bit = np.left_shift(np.uint8(1), (cells & np.uint64(7)).astype(np.uint8))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
    if len(at):
        plane[at[first]] |= np.bitwise_or.reduceat(bit, first)


def _bits(plane: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return ((plane[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _pack(numbers: np.ndarray) -> bytes:
    """Small unsigned numbers in two bytes each where they fit, else four."""
    width = 4 if len(numbers) and numbers.max() >= 1 << 16 else 2
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


class TaskSketch:
    """One task's count-min sketch; counters are 0, 1 or "2 and more"."""

    def __init__(self, depth: int, width_log2: int):
        self.width_log2, self.windows = width_log2, 0
        self.seen = [np.zeros(1 << (width_log2 - 3), dtype=np.uint8) for _ in range(depth)]
        self.repeated = [np.zeros(1 << (width_log2 - 3), dtype=np.uint8) for _ in range(depth)]

    def add(self, windows: np.ndarray) -> None:
        self.windows += len(windows)
        for row, (seen, repeated) in enumerate(zip(self.seen, self.repeated)):
            cells = np.sort(_cells(windows, row, self.width_log2))
            same = np.zeros(len(cells), dtype=bool)
            same[1:] = cells[1:] == cells[:-1]
            _set_bits(repeated, np.unique(cells[same]))
            cells = cells[~same]
            _set_bits(repeated, cells[_bits(seen, cells)])
            _set_bits(seen, cells)

    def blocks(self) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        squeeze, size = zstandard.ZstdCompressor(level=1), 1 << (min(_BLOCK_LOG2, self.width_log2) - 3)
        yield -1, 0, self.windows, b"", b""
        for row, (seen, repeated) in enumerate(zip(self.seen, self.repeated)):
            for block in range(len(seen) // size):
                part = slice(block * size, (block + 1) * size)
                if seen[part].any():
                    yield row, block, 0, squeeze.compress(seen[part].tobytes()), squeeze.compress(repeated[part].tobytes())


def _merge_blocks(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counters of one block over all tasks, one at a time."""
    row, block = key[0].as_py(), key[1].as_py()
    expand, seen, repeated, windows = zstandard.ZstdDecompressor(), None, None, 0
    for batch in parts:
        for n, s, r in zip(*(batch.column(c).to_pylist() for c in ("windows", "seen", "repeated"))):
            windows += n
            if row >= 0:
                s, r = (np.frombuffer(expand.decompress(x), dtype=np.uint8) for x in (s, r))
                seen, repeated = (s, r) if seen is None else (seen | s, repeated | r | (seen & s))
    squeeze = zstandard.ZstdCompressor(level=1)
    planes = [squeeze.compress(x.tobytes()) if row >= 0 else b"" for x in (seen, repeated)]
    yield pa.RecordBatch.from_arrays(
        [*(pa.array([v], pa.int32()) for v in (row, block)), pa.array([windows], pa.int64()), *(pa.array([x], pa.binary()) for x in planes)],
        names=["row", "block", "windows", "seen", "repeated"],
    )


def _u4(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u4")


def later_windows(
    docs: DataFrame,
    window: int = 20,
    depth: int = 2,
    width_log2: int | None = None,
    most_log2: int = 28,
    shard_windows: int = 2_000_000,
    sketches: int | None = None,
) -> DataFrame:
    """``doc_id, crc, starts``: packed u4 word positions of windows that come first elsewhere.

    ``docs`` has ``doc_id, text, crc`` (the text's CRC-32).  Shards of
    fingerprints send what they find to parts of documents, as packed arrays.
    """
    held = text_bytes(docs)
    width_log2 = width_log2 or counters_log2(held, most_log2)
    sketches = sketches or sketch_tasks(docs.sparkSession, held)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        hasher, own = WordHasher(1), TaskSketch(depth, width_log2)
        for batch in batches:
            for part in batch_slices(batch, 0, 2 * SLICE_CHARS):
                words, bounds = hasher.words(part.column(0))
                own.add(run_hashes(words, window)[run_starts(bounds, window)])
        for made in own.blocks():
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            names = ["row", "block", "windows", "seen", "repeated"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], names=names)

    own = docs.select("text").coalesce(sketches).mapInArrow(sketch, _REPEATED_SCHEMA)
    if sketches > MERGED_SKETCHES:  # a tree of two levels
        part = F.expr(f"spark_partition_id() div {MERGED_SKETCHES}").alias("part")
        own = own.select(part, *[c.split()[0] for c in _REPEATED_SCHEMA.split(", ")])
        own = own.groupBy("row", "block", "part").applyInArrow(_merge_blocks, _REPEATED_SCHEMA)
    merged = own.groupBy("row", "block").applyInArrow(_merge_blocks, _REPEATED_SCHEMA).select("row", "block", "windows", "repeated")
    merged = merged.collect()  # the sketch: its size is fixed by depth and width_log2
    windows = sum(r["windows"] for r in merged)
    shards = max(1, windows // shard_windows)
    shared = docs.sparkSession.sparkContext.broadcast([(r["row"], r["block"], bytes(r["repeated"])) for r in merged if r["row"] >= 0])
    size = 1 << (min(_BLOCK_LOG2, width_log2) - 3)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        hasher = WordHasher(1)
        expand = zstandard.ZstdDecompressor()
        planes = [np.zeros(1 << (width_log2 - 3), dtype=np.uint8) for _ in range(depth)]
        for row, block, frame in shared.value:
            planes[row][block * size : (block + 1) * size] = np.frombuffer(expand.decompress(frame), dtype=np.uint8)
        for batch in batches:
            for cut in batch_slices(batch, 1, 4 * SLICE_CHARS):
                # By doc_id, so that within a slice the order of windows is that of (doc_id, start).
                cut = cut.sort_by("doc_id")
                keys, crcs = cut.column(0).to_numpy(), cut.column(2).to_numpy().astype("<u4")
                words, others, bounds = hasher.halves(cut.column(1))
                at = run_starts(bounds, window)
                high = run_hashes(words, window)[at]
                keep = np.ones(len(high), dtype=bool)
                for row in range(depth):
                    keep[keep] = _bits(planes[row], _cells(high[keep], row, width_log2))
                at, high = at[keep], high[keep]
                if not len(at):
                    continue
                low = (run_hashes(others, window, 1)[at] >> np.uint64(32)).astype(np.uint32)
                doc = (np.searchsorted(bounds, at, "right") - 1).astype("<u4")
                start = (at - bounds[doc]).astype("<u4")
                twins = bool((keys[1:] == keys[:-1]).any())
                order = np.lexsort((start, keys[doc], low, high) if twins else (low, high))
                high, low, doc, start = high[order], low[order], doc[order], start[order]
                new = np.ones(len(high), dtype=bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                again = (keys[doc] != keys[doc[head]]) | (start != start[head])
                shard = (high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                prints = np.empty(len(high), dtype=[("high", "<u8"), ("low", "<u4")])
                prints["high"], prints["low"] = high, low
                rows = []
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    part = slice(edges[s], edges[s + 1])
                    used, own = np.unique(doc[part], return_inverse=True)
                    more = again[part]
                    places = [_pack(x) for x in (own[~more], start[part][~more], own[more], start[part][more])]
                    rows.append((s, keys[used].tolist(), crcs[used].tobytes(), *places[:2], prints[part][~more].tobytes(), *places[2:]))
                kinds = (pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6)
                names = ["shard", "doc_ids", "crcs", "docs", "starts", "prints", "later_docs", "later_starts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def later(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        # Rows of the shard's documents are numbered; doc and crc belong to a number.
        numbers, starts, prints, done, done_starts, base = [], [], [], [], [], 0
        id_lists, crc_lists = rows.column("doc_ids").to_pylist(), rows.column("crcs").to_pylist()
        columns = (rows.column(c).to_pylist() for c in ("docs", "starts", "prints", "later_docs", "later_starts"))
        for ids, d, s, p, ld, ls in zip(id_lists, *columns):
            numbers.append(base + _unpack(d))
            starts.append(_unpack(s).astype(np.uint32))
            prints.append(np.frombuffer(p, dtype=[("high", "<u8"), ("low", "<u4")]))
            done.append(base + _unpack(ld))
            done_starts.append(_unpack(ls).astype(np.uint32))
            base += len(ids)
        ids, crcs = np.concatenate([np.array(i, dtype=np.int64) for i in id_lists]), _u4(crc_lists)
        number, start, prints = np.concatenate(numbers), np.concatenate(starts), np.concatenate(prints)
        order = np.lexsort((start, ids[number], prints["low"], prints["high"]))
        number, start, high, low = number[order], start[order], prints["high"][order], prints["low"][order]
        new = np.ones(len(number), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        lost = (ids[number] != ids[number[head]]) | (start != start[head])
        number = np.concatenate([number[lost], *done])
        start = np.concatenate([start[lost], *done_starts])
        # Parts by document; within a part by document and text.
        part = (mix(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[np.lexsort((crcs, ids, part))] = np.arange(len(ids))
        order = np.argsort(rank[number], kind="stable")
        number, start = number[order], start[order]
        edges = np.searchsorted(part[number], np.arange(shards + 1))
        out = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own = number[edges[p] : edges[p + 1]]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            counts = np.diff(np.append(first, len(own)))
            used = own[first]
            out.append((p, ids[used].tolist(), crcs[used].tobytes(), _pack(counts), _pack(start[edges[p] : edges[p + 1]])))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "doc_ids", "crcs", "counts", "starts"])

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        id_lists, crcs, counts, starts = (rows.column(c).to_pylist() for c in ("doc_ids", "crcs", "counts", "starts"))
        many = np.concatenate([_unpack(n) for n in counts])
        doc = np.repeat(np.concatenate([np.array(ids, dtype=np.int64) for ids in id_lists]), many)
        crc = np.repeat(_u4(crcs), many)
        start = np.concatenate([_unpack(s) for s in starts]).astype("<u4")
        order = np.lexsort((crc, doc))
        doc, crc, start = doc[order], crc[order], start[order]
        edges = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]), [True])))
        blobs = [start[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        columns = [pa.array(doc[edges[:-1]]), pa.array(crc[edges[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())]
        return pa.table(columns, names=["doc_id", "crc", "starts"])

    found = docs.mapInArrow(entries, _ENTRY_SCHEMA).groupBy("shard").applyInArrow(later, _PLACE_SCHEMA)
    return found.groupBy("part").applyInArrow(gather, "doc_id long, crc long, starts binary")


def substring_dedup(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", **sketch: int
) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: each text without its repeated words.

    The words that stay are joined by one space.  One shuffle brings texts and
    their positions together.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("crc", F.crc32("text"))
    found = later_windows(rows.where("doc_id is not null"), window, **sketch)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                if blob:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.frombuffer(blob, "<u4").astype(np.int64)
                    at = at[at + window <= len(words)]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    words = list(compress(words, stays.tolist()))
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    joined = rows.join(found, ["doc_id", "crc"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, text string")
