"""Approximate nearest neighbours: one HNSW graph per shard, results merged.

Rows go to shards by a hash of their vector, so every shard is a random sample
of bounded size and equal vectors meet.  A shard's distinct vectors form a
hierarchical navigable small-world graph, stored as flat arrays: vectors, level
of each node, and for each level a fixed number of neighbour slots.  The index
is a table with one row per shard.  Every query is searched in every shard; a
shard returns its nearest rows by exact distance in double precision, and a
window merges the shards' short lists.

Up to ``MANY_SHARDS`` shards keep to ``shard_rows`` rows; beyond that shards grow
with the square root of the table, to 16 times that size at most, so that
queries times shards grows slower than the square of the rows; searches in
larger shards are wider.

Each shard has a partition of its own, in building and in searching.  Searches
move queries to the shards' graphs, never rows to queries; a task holds one
graph, and the queries stream past it.

Nulls and edge cases: vectors that are null, empty, zero, or that hold a null or
non-finite number take no part, nor do null ids; vectors of different lengths do
not meet (:func:`nearest` has an index for each length); rows with equal vectors are told apart by smaller id first; a query whose
id occurs twice is searched once (smaller vector first); fewer than ``k``
candidates give fewer rows; asking for more rows than the index keeps ids of
equal vectors for raises ValueError; an empty table gives none; further columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import write_table

INDEX_SCHEMA = "shard int, dim int, max_k int, vectors binary, levels binary, links array<binary>, entry int, ids array<binary>"

#: Shards of the first size; more rows make shards larger as well as more.
MANY_SHARDS = 256


def shard_count(rows: int, shard_rows: int) -> int:
    most = rows / shard_rows
    grown = max(most / 16, math.sqrt(most * MANY_SHARDS))
    return max(1, round(min(most, grown)))


class Graph:
    """HNSW over distinct vectors; neighbours of a level are one flat array."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.links, self.entry = vectors, levels, links, entry

    def _greedy(self, query: np.ndarray, node: int, level: int) -> int:
        best = float(np.square(self.vectors[node] - query).sum())
        while True:
            near = self.links[level][node]
            near = near[near >= 0]
            if not len(near):
                return node
            d = np.square(self.vectors[near] - query).sum(axis=1)
            at = int(d.argmin())
            if d[at] >= best:
                return node
            best, node = float(d[at]), int(near[at])

    def _layer(self, query: np.ndarray, node: int, level: int, width: int) -> list[tuple[float, int]]:
        first = float(np.square(self.vectors[node] - query).sum())
        seen = bytearray(len(self.vectors))
        seen[node] = 1
        todo, found = [(first, node)], [(-first, node)]
        links, vectors = self.links[level], self.vectors
        while todo:
            d, at = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= width:
                break
            near = [n for n in links[at].tolist() if n >= 0 and not seen[n]]
            if not near:
                continue
            for n in near:
                seen[n] = 1
            diff = vectors[near] - query
            for dn, n in zip(np.einsum("ij,ij->i", diff, diff).tolist(), near):
                if len(found) < width:
                    heapq.heappush(found, (-dn, n))
                    heapq.heappush(todo, (dn, n))
                elif dn < -found[0][0]:
                    heapq.heapreplace(found, (-dn, n))
                    heapq.heappush(todo, (dn, n))
        return sorted((-d, n) for d, n in found)

    def search(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        """About the ``width`` nearest nodes as (squared distance, node)."""
        if self.entry < 0:
            return []
        node = self.entry
        for level in range(int(self.levels[self.entry]), 0, -1):
            node = self._greedy(query, node, level)
        return self._layer(query, node, 0, width)


def _choose(vectors: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Neighbours that are nearer to the node than to one chosen before; then the nearest left."""
    chosen: list[int] = []
    spare: list[int] = []
    for d, n in found:
        if len(chosen) == most:
            break
        if chosen:
            diff = vectors[chosen] - vectors[n]
            if np.einsum("ij,ij->i", diff, diff).min() < d:
                spare.append(n)
                continue
        chosen.append(n)
    return chosen + spare[: most - len(chosen)]


def build_graph(vectors: np.ndarray, m: int = 12, width: int = 64, seed: int = 11) -> Graph:
    """Insert the vectors one by one; level 0 has ``2 * m`` slots, others ``m``."""
    count = len(vectors)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - rng.random(count)) / math.log(m)).astype(np.int32), 12)
    top = int(levels.max()) if count else 0
    links = [np.full((count, 2 * m if level == 0 else m), -1, dtype=np.int32) for level in range(top + 1)]
    graph = Graph(vectors, levels, links, -1)
    for node in range(count):
        if graph.entry < 0:
            graph.entry = node
            continue
        query, at, own = vectors[node], graph.entry, int(levels[node])
        highest = int(levels[graph.entry])
        for level in range(highest, own, -1):
            at = graph._greedy(query, at, level)
        for level in range(min(own, highest), -1, -1):
            found = graph._layer(query, at, level, width)
            at = found[0][1]
            chosen = _choose(vectors, found, m)
            links[level][node, : len(chosen)] = chosen
            for other in chosen:
                row = links[level][other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                near = np.append(row, node)
                diff = vectors[near] - vectors[other]
                d = np.einsum("ij,ij->i", diff, diff)
                order = np.argsort(d, kind="stable")
                kept = _choose(vectors, list(zip(d[order].tolist(), near[order].tolist())), len(row))
                row[:] = kept + [-1] * (len(row) - len(kept))
        if own > highest:
            graph.entry = node
    return graph


def usable(vector: Column, dim: int | Column) -> Column:
    values = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(values, lambda x: x != 0), F.lit(False))


def usable_lengths(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> list[int]:
    """The lengths of usable vectors, each a space of its own: between vectors of two lengths there is no distance."""
    size = F.size(vector_col)
    fine = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), size))
    return [r["dim"] for r in fine.select(size.alias("dim")).distinct().orderBy("dim").collect()]


def _vectors(rows: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    fine = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), dim))
    return fine.select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector")
    )


def build_index(
    rows: DataFrame,
    dim: int,
    shard_rows: int = 4096,
    m: int = 12,
    width: int = 80,
    max_k: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Stored index over every usable row: one row per shard (about ``shard_rows`` rows).

    Equal vectors share a shard and one node.  A node lists the ``max_k + 1``
    smallest ids of its vector: ties go to smaller ids, so no search for up to
    ``max_k`` rows can return another one.
    """
    vectors = _vectors(rows, dim, id_col, vector_col)
    shards = shard_count(rows.count(), shard_rows)
    # Copies beyond the smallest ids are left out before the shuffle by vector.
    order = Window.partitionBy("vector").orderBy("vec_id")
    vectors = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_k + 1)
    packed = vectors.groupBy("vector").agg(F.collect_list("vec_id").alias("ids"))
    placed = packed.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[bytes, list[int]] = {}
        shard = None
        for batch in batches:  # all of one shard
            shard = batch.column(2)[0].as_py() if batch.num_rows else shard
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for row, ids in zip(flat, batch.column(1).to_pylist()):
                nodes.setdefault((row + 0.0).tobytes(), []).extend(ids)
        if not nodes:
            return
        names = sorted(nodes)
        order = np.random.default_rng(7).permutation(len(names)).tolist()
        names = [names[k] for k in order]
        own = np.frombuffer(b"".join(names), dtype=np.float64).reshape(-1, dim)
        graph = build_graph(own, m, width)
        ids = [np.sort(np.array(nodes[n], dtype="<i8"))[: max_k + 1].tobytes() for n in names]
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array([v], pa.int32()) for v in (shard, dim, max_k)),
                pa.array([own.tobytes()], pa.binary()),
                pa.array([graph.levels.astype("<i4").tobytes()], pa.binary()),
                pa.array([[x.astype("<i4").tobytes() for x in graph.links]], pa.list_(pa.binary())),
                pa.array([graph.entry], pa.int32()),
                pa.array([ids], pa.list_(pa.binary())),
            ],
            names=["shard", "dim", "max_k", "vectors", "levels", "links", "entry", "ids"],
        )

    dealt = placed.select("vector", "ids", "shard").repartitionById(shards, "shard")
    return write_table(dealt.mapInArrow(build, INDEX_SCHEMA), "hnsw")


def load_graph(row: dict) -> tuple[Graph, list[np.ndarray]]:
    vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, row["dim"])
    count = len(vectors)
    links = [np.frombuffer(x, dtype="<i4").reshape(count, -1) for x in row["links"]]
    ids = [np.frombuffer(x, dtype="<i8") for x in row["ids"]]
    return Graph(vectors, np.frombuffer(row["levels"], dtype="<i4"), links, row["entry"]), ids


def nearest_in_graph(
    graph: Graph, ids: list[np.ndarray], query: np.ndarray, own: int | None, k: int, width: int
) -> list[tuple[int, float]]:
    """``(vec_id, distance)`` of the nearest rows found, without the query's own."""
    out: list[tuple[float, int]] = []
    found = graph.search(query, width)
    exact = sorted((math.sqrt(float(np.square(graph.vectors[n] - query).sum())), n) for _, n in found)
    for d, n in exact:
        if len(out) >= k and d > out[k - 1][0]:
            break
        # Of equal vectors the k + 1 smallest ids are enough for k rows.
        out += [(d, v) for v in ids[n][: k + 1].tolist() if v != own]
        out.sort()
    return [(v, d) for d, v in out[:k]]


def search(
    index: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int = 10,
    width: int = 160,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: Euclidean distance to the nearest rows found.

    Each shard's graph meets each query once, and sends on at most ``k`` rows
    for it.  ``width`` is that of a shard of 4096 rows.
    """
    held = index.agg(F.max("shard").alias("last"), F.min("max_k").alias("max_k")).first()
    if held["max_k"] is not None and k > held["max_k"]:
        raise ValueError(f"the index keeps ids for {held['max_k']} rows, not for {k}")
    shards = 0 if held["last"] is None else held["last"] + 1
    asked = _vectors(queries, dim, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)) if shards else F.array().cast("array<int>"))
    kinds = {f.name: f.dataType for f in index.schema}
    graphs = index.select("shard", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("vector"), "vectors", "levels", "links", "entry", "ids")
    asked = asked.select(
        each.alias("shard"), "vec_id", "vector", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("vectors", "levels", "links", "entry", "ids")]
    )
    met = graphs.unionByName(asked).repartitionById(max(1, shards), "shard").sortWithinPartitions(F.col("vec_id").asc_nulls_first())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids, wide = None, [], width
        for batch in batches:
            first = 0
            if graph is None and batch.num_rows:  # the graph is the partition's first row
                row = {c: batch.column(c)[0].as_py() for c in ("vec_id", "vectors", "levels", "links", "entry", "ids")}
                if row["vec_id"] is not None:
                    return  # a shard without rows
                graph, ids = load_graph({**row, "dim": dim})
                wide, first = round(width * max(1.0, len(ids) / 4096) ** 0.5), 1
            keys = batch.column("vec_id").to_pylist()[first:]
            vectors = batch.column("vector").slice(first).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            out = [(q, v, d) for q, vector in zip(keys, vectors) for v, d in nearest_in_graph(graph, ids, vector, q, k, max(wide, k + 1))]
            cols = list(zip(*out)) or [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **bounds: int) -> DataFrame:
    """The result of :func:`search` for all lengths of vectors: an index for each, which its queries meet."""
    found = [
        search(build_index(rows, dim, id_col=id_col, vector_col=vector_col, **bounds), queries, dim, k, id_col=id_col, vector_col=vector_col)
        for dim in usable_lengths(rows, id_col, vector_col)
    ]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)
