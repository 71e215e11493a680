"""Exact search for the largest inner products, by descending length with rotated partial sums.

Vectors become whole numbers first, so scores are exact.  Equal vectors become
one row with the smallest ids, and rows are range-partitioned by descending
length into shards, each a row of a stored table.  All vectors are turned by the
singular vectors of the whole table (from summed products of components), which
puts most of a product into the first components.

A query's bar is its last place among the longest vectors of all.  A shard whose
longest vector times the query's length stays under the bar is not visited: of
the shards in order of length a block of queries goes to a leading part.  In a
shard, runs of vectors by descending length are first multiplied in the leading
components; by Cauchy and Schwarz what is left is at most the product of the two
remainders' lengths, and pairs that stay under the bar end there.  Survivors get
further components, then the exact product of whole numbers.  Floating point
only rules pairs out, with room for its rounding.

Nulls and edge cases: rows with a null id, and vectors that are null, empty or
hold null or non-finite components take no part, nor do those with a component
beyond 2^31 or so large that a product could pass 2^63; vectors of different
lengths do not meet, each length being a space of its own; a query whose id
occurs twice is searched once in each space (smaller vector first), and no row
with the query's id is found for it; repeated rows of one id and vector are one;
ties go to smaller ids; fewer than ``k`` candidates
give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import write_table

#: Distinct vectors of a shard, of the leading ones that set the bars (and numbers in these), and queries that travel together.
SHARD_ROWS, HEAD_ROWS, HEAD_NUMBERS, BLOCK_QUERIES = 16_384, 2048, 1 << 21, 512

#: The bar of a query without enough leading vectors.
NO_BAR = -(2**63)

#: Vectors of a run; pairs that a step looks at together; longer vectors than this are not turned.
RUN_ROWS, STEP_PAIRS, TURNED_DIMS = 2048, 1 << 16, 512

FOUND = "query_id long, vec_id long, score long"


def whole_numbers(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, dim, vector, norm2`` of the usable rows, components as ``floor(scale * x)``."""
    size = F.size(vector_col)
    values = F.transform(vector_col, lambda x: x.cast("double"))
    most = F.least(F.lit(2.0**31 - 1), F.sqrt(F.lit(2.0**62) / F.greatest(size, F.lit(1))))
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < most - 1))
    usable = rows.where(F.col(id_col).isNotNull() & F.coalesce((size > 0) & fine, F.lit(False)))
    numbers = F.transform(values, lambda x: F.floor(x * scale).cast("long"))
    out = usable.select(F.col(id_col).cast("long").alias("vec_id"), size.alias("dim"), numbers.alias("vector"))
    return out.withColumn("norm2", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, the greatest first; sums of products are added up by tasks."""
    if dim > TURNED_DIMS:
        return np.eye(dim)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            total += x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "xy"])

    sums = vectors.select("vector").mapInArrow(products, "i int, j int, xy double").groupBy("i", "j").agg(F.sum("xy").alias("xy"))
    whole = np.zeros((dim, dim))
    for r in sums.collect():  # dim * (dim + 1) / 2 rows
        whole[r["i"], r["j"]] = whole[r["j"], r["i"]] = r["xy"]
    return np.ascontiguousarray(np.linalg.eigh(whole)[1][:, ::-1])


def build_index(vectors: DataFrame, dim: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard: ``shard, top, vectors, ids, n_ids``, by descending length; ``top`` is the greatest."""
    shards = max(1, -(-vectors.count() // shard_rows))
    order = [F.desc("norm2"), F.xxhash64("vector")]
    dealt = vectors.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt = dealt.select("vector", "ids", "norm2", F.spark_partition_id().alias("shard"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        numbers = np.concatenate([_matrix(b.column(0), dim) for b in parts]).astype("<i4")
        ids = np.concatenate([b.column(1).flatten().to_numpy() for b in parts]).astype("<i8")
        n_ids = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in parts]).astype("<i4")
        top = float(parts[0].column(2)[0].as_py()) ** 0.5
        columns = [pa.array([parts[0].column(3)[0].as_py()], pa.int32()), pa.array([top])]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (numbers, ids, n_ids)]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "top", "vectors", "ids", "n_ids"])

    return write_table(dealt.mapInArrow(pack, "shard int, top double, vectors binary, ids binary, n_ids binary"), "by-length")


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` highest scores, ties by smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.searchsorted(query, query)
    keep = np.arange(len(query)) - starts < k
    return query[keep], ids[keep], scores[keep]


class Shard:
    """A loaded shard with its vectors turned, and the lengths of what is left after each of ``steps`` components."""

    def __init__(self, vectors: bytes, ids: bytes, n_ids: bytes, turn: np.ndarray):
        dim = len(turn)
        self.numbers = np.frombuffer(vectors, dtype="<i4").reshape(-1, dim).astype(np.int64)
        self.ids, self.n_ids = np.frombuffer(ids, dtype="<i8"), np.frombuffer(n_ids, dtype="<i4").astype(np.int64)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.turn, self.steps = turn, sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2), dim})
        self.turned, self.left, self.length = self._turned(self.numbers)

    def _turned(self, numbers: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        turned = numbers.astype(np.float64) @ self.turn
        left = {s: np.sqrt(np.square(turned[:, s:]).sum(axis=1)) for s in self.steps}
        return turned, left, np.sqrt(np.square(turned).sum(axis=1))

    def search(self, own: np.ndarray, queries: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place of the query, vec_id, score)`` of the best rows that reach ``bar``, without the query's ``own`` id."""
        turned, left, length = self._turned(queries)
        bar = bar.copy()
        found = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        for at in range(0, len(self.numbers), RUN_ROWS):
            run = slice(at, at + RUN_ROWS)
            room = 1e-9 * length * self.length[at] + 1e-6  # of rounding
            active = np.flatnonzero(length * self.length[at] >= bar - room)
            if not len(active):
                break
            size = max(1, STEP_PAIRS // max(1, len(self.numbers[run])))
            for begin in range(0, len(active), size):
                q = active[begin : begin + size]
                under, reach, before = (bar - room)[q, None], 0.0, 0
                for step in self.steps:  # all pairs, until few are left
                    reach = reach + turned[q, before:step] @ self.turned[run, before:step].T
                    i, j = np.nonzero(reach + left[step][q, None] * self.left[step][None, run] >= under)
                    before = step
                    if 16 * len(i) < reach.size:
                        break
                sums, i, j = reach[i, j], q[i], j + at
                for step in self.steps[self.steps.index(before) + 1 :]:
                    sums = sums + np.einsum("ij,ij->i", turned[i, before:step], self.turned[j, before:step])
                    keep = sums + left[step][i] * self.left[step][j] >= (bar - room)[i]
                    sums, i, j, before = sums[keep], i[keep], j[keep], step
                scores = np.einsum("ij,ij->i", queries[i], self.numbers[j])
                keep = scores >= bar[i]
                scores, i, j = scores[keep], i[keep], j[keep]
                n = self.n_ids[j]
                ids = self.ids[np.repeat(self.first_id[j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                i, scores = np.repeat(i, n), np.repeat(scores, n)
                other = ids != own[i]
                found = best_of(*(np.concatenate([a, b[other]]) for a, b in zip(found, (i, ids, scores))), k)
            bar = raised(bar, found[0], found[2], k)
        return found


def raised(bar: np.ndarray, query: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Bars that follow the last of ``k`` places, where a query has that many (rows as of :func:`best_of`)."""
    out = bar.copy()
    last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
    out[query[last]] = np.maximum(out[query[last]], scores[last])
    return out


def _space(vectors: DataFrame, queries: DataFrame, dim: int, k: int, shard_rows: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = vectors.sparkSession
    index = build_index(vectors, dim, shard_rows)
    turn = rotation(vectors, dim)
    tops = np.array([r["top"] for r in index.select("shard", "top").orderBy("shard").collect()])  # a number a shard
    shards = index.agg(F.max("shard").alias("last")).first()["last"]
    if shards is None:
        return spark.createDataFrame([], FOUND)
    held = index.select("shard").orderBy("shard").collect()
    numbers = np.array([r["shard"] for r in held])
    leading = max(k + 1, min(HEAD_ROWS, HEAD_NUMBERS // dim))
    head = vectors.orderBy(F.desc("norm2"), F.xxhash64("vector")).select("vector", "ids").limit(leading).collect()
    heads = np.repeat(np.array([r["vector"] for r in head], dtype=np.int64), [len(r["ids"]) for r in head], axis=0)
    head_ids = np.array([v for r in head for v in r["ids"]], dtype=np.int64)
    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin in range(0, len(ids), 128):
                own = slice(begin, begin + 128)
                x = _matrix(batch.column(1).slice(begin, 128), dim)
                scores = x @ heads.T
                scores[ids[own, None] == head_ids[None, :]] = NO_BAR
                bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), NO_BAR)
                length = np.sqrt(np.square(x.astype(np.float64)).sum(axis=1))
                ratio = np.divide(bar, length, out=np.full(len(x), float(NO_BAR)), where=(length > 0) & (bar > 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, 128), batch.column(1).slice(begin, 128), pa.array(bar), pa.array(ratio)], names=["vec_id", "vector", "bar", "ratio"]
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_QUERIES):
                part = batch.slice(begin, BLOCK_QUERIES)
                needed = float(part.column(3).to_numpy().min())
                reach = int((tops * (1 + 1e-9) >= needed).sum())  # shards are in order of length
                arrays = part.column(0).to_numpy().astype("<i8"), _matrix(part.column(1), dim).astype("<i4"), part.column(2).to_numpy().astype("<i8")
                columns = [pa.array([numbers[:reach].tolist()], pa.list_(pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
                yield pa.RecordBatch.from_arrays(columns, names=["shards", "own", "queries", "bars"])

    asked = queries.select("vec_id", "vector").mapInArrow(bars, "vec_id long, vector array<long>, bar long, ratio double")
    asked = write_table(asked, "bars")  # as ranges are sampled before they are dealt
    blocks = asked.repartitionByRange(F.desc("ratio"), "vec_id").sortWithinPartitions(F.desc("ratio"), "vec_id")
    blocks = blocks.mapInArrow(pack, "shards array<int>, own binary, queries binary, bars binary")
    names = ("vectors", "ids", "n_ids", "own", "queries", "bars")
    null = F.lit(None).cast("binary")
    rows = index.select("shard", F.lit(0).alias("kind"), "vectors", "ids", "n_ids", *[null.alias(c) for c in names[3:]])
    sent = blocks.select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), *[null.alias(c) for c in names[:3]], *names[3:])
    met = rows.unionByName(sent).repartitionById(shards + 1, "shard").sortWithinPartitions("kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in names}
                if row["vectors"] is not None:  # the first row of its partition
                    shard = Shard(row["vectors"], row["ids"], row["n_ids"], turn)
                    continue
                own = np.frombuffer(row["own"], dtype="<i8")
                asked = np.frombuffer(row["queries"], dtype="<i4").reshape(-1, dim).astype(np.int64)
                i, ids, scores = shard.search(own, asked, np.frombuffer(row["bars"], dtype="<i8"), k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i].astype(np.int64)), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return met.mapInArrow(meet, FOUND)


def largest_products(
    rows: DataFrame,
    asked: Column,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row where ``asked`` holds the ``k`` rows of largest inner product."""
    numbers = whole_numbers(rows, scale, id_col, vector_col)
    # Of equal vectors the k + 1 smallest ids are enough for k rows; the rest is left out before the shuffle.
    order = Window.partitionBy("dim", "vector").orderBy("vec_id")
    placed = numbers.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
    vectors = placed.groupBy("dim", "vector", "norm2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    vectors = write_table(vectors, "vectors")
    queries = whole_numbers(rows.where(asked), scale, id_col, vector_col).groupBy("dim", "vec_id").agg(F.min("vector").alias("vector"))
    dims = [r["dim"] for r in vectors.select("dim").distinct().orderBy("dim").collect()]  # lengths of vectors
    spaces = [_space(vectors.where(F.col("dim") == d), queries.where(F.col("dim") == d), d, k, shard_rows) for d in dims]
    found = reduce(DataFrame.unionByName, spaces) if spaces else rows.sparkSession.createDataFrame([], FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
