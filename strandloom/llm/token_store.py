"""Token-ID output: bit-plane shuffled, zstandard-compressed id chunks.

A store is one Parquet dataset.  Each row is a chunk: a run of whole documents
in ascending order of ``doc_id``.  Its ``payload`` holds the ids in blocks of a
fixed size; each block is transposed into byte planes (or bit planes), plane p
of all blocks is one zstandard frame, and a header gives the frames' lengths.
The other columns are the chunk index, which can be read without a payload.

Nulls and edge cases: a null text counts as empty and has only the end id; a
null ``doc_id`` sorts first; rows with equal ids are ordered by a hash of their
text, and may lie in several parts of the store; an empty table gives an empty
store; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import batch_slices, id_and_text
from strandloom.llm.unit_encoder import SLICE_BYTES, worker_encoder

_MAGIC = b"BPS1"
_HEAD = "<4sIQBB"

CHUNK_SCHEMA = (
    "part int, chunk int, first_in_part long, n_ids long, doc_ids array<bigint>, doc_lengths array<bigint>, payload binary"
)


def encode_planes(ids: np.ndarray, block: int = 4096, bits: bool = False, level: int = 1) -> bytes:
    """Payload of a chunk of unsigned 32-bit ids.

    The last block is filled up with zeros; the header keeps the true count.
    Planes above the largest id's are left out.
    """
    padded = np.zeros(-(-len(ids) // block) * block, dtype="<u4")
    padded[: len(ids)] = ids
    blocks = padded.view(np.uint8).reshape(-1, block, 4)
    top = int(ids.max()) if len(ids) else 0
    if bits:
        planes = [
            np.packbits((blocks[:, :, b // 8] >> (b % 8)) & 1, axis=1).tobytes() for b in range(max(1, top.bit_length()))
        ]
    else:
        planes = [blocks[:, :, b].tobytes() for b in range(max(1, -(-top.bit_length() // 8)))]
    squeeze = zstandard.ZstdCompressor(level=level)
    frames = [squeeze.compress(p) for p in planes]
    head = struct.pack(_HEAD, _MAGIC, block, len(ids), len(frames), int(bits))
    return head + struct.pack(f"<{len(frames)}Q", *map(len, frames)) + b"".join(frames)


def decode_planes(payload: bytes) -> np.ndarray:
    """The ids of a payload made by :func:`encode_planes`."""
    magic, block, count, n_frames, bits = struct.unpack_from(_HEAD, payload)
    if magic != _MAGIC:
        raise ValueError("not a chunk of this format")
    lengths = struct.unpack_from(f"<{n_frames}Q", payload, struct.calcsize(_HEAD))
    at = struct.calcsize(_HEAD) + 8 * n_frames
    expand = zstandard.ZstdDecompressor()
    out = np.zeros((-(-count // block), block, 4), dtype=np.uint8)
    for b, length in enumerate(lengths):
        plane = np.frombuffer(expand.decompress(payload[at : at + length]), dtype=np.uint8)
        at += length
        if bits:
            out[:, :, b // 8] |= np.unpackbits(plane.reshape(-1, block // 8), axis=1) << (b % 8)
        else:
            out[:, :, b] = plane.reshape(-1, block)
    return out.reshape(-1).view("<u4")[:count]


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    keep_space: bool,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_ids: int = 1 << 18,
    block: int = 4096,
    bits: bool = False,
) -> None:
    """Encode whole texts and write them as a store at ``path``, by ``doc_id``.

    Range partitioning moves each text once; a task then streams its documents
    and holds one chunk (``chunk_ids`` ids, or one longer document) at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, keep_space)
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([chunk], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode_planes(ids, block, bits)], pa.binary()),
                ],
                names=["part", "chunk", "first_in_part", "n_ids", "doc_ids", "doc_lengths", "payload"],
            )

        for batch in batches:
            for part_of in batch_slices(batch, 1, SLICE_BYTES):
                ids, counts = encoder.encode(part_of.column(1))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                held.append(ids)
                doc_ids += part_of.column(0).to_pylist()
                lengths += counts.tolist()
                if sum(map(len, held)) >= chunk_ids:
                    yield flush()
                    first += sum(map(len, held))
                    chunk, held, doc_ids, lengths = chunk + 1, [], [], []
        if doc_ids:
            yield flush()

    rows = id_and_text(docs, id_col, text_col)
    # Hash and row number let the rows of one id, and equal rows, be cut into several ranges.
    order = ["doc_id", "hash", "row"]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(chunks, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: ``doc_id, start, n_tokens, ids`` (little-endian u4)."""
    stored = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    # One row for each part of the store: a few bytes for thousands of documents.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, keys, lengths, payload = (batch.column(c)[row].as_py() for c in range(4))
                sizes = np.array(lengths, dtype=np.int64)
                raw = decode_planes(payload).tobytes()
                ends = np.cumsum(sizes)
                blobs = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(start + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    rows = stored.join(F.broadcast(parts), "part").select(
        (F.col("part_start") + F.col("first_in_part")).alias("start"), "doc_ids", "doc_lengths", "payload"
    )
    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
