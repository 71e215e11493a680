"""Ranked lexical search over K2-treaps of a term-document grid.

The grid has a row for each term that is asked for, rarest first, and a column
for each document; a cell holds the impact of the term in the document.  A task
cuts the documents that it reads into ranges of bounded size and turns each into
a K2-treap: a quadtree of the non-empty cells, level by level as four-bit maps
with the maximum of each cell's impacts, stored as its difference from its
parent's.  No shuffle is needed for that; the treaps are a table.

A search descends the paths of all rows of an item at once: a document range
carries the cell of each of the item's terms, its bound is the weighted sum of
these cells' maxima, and ranges with the highest bound are halved first, until
no range can reach the item's last place.  Each range of documents meets each
item once; a task hands on an item's best rows of all its ranges, and a window
merges these short lists.

Items pass in blocks whose texts are at most ``ITEM_BYTES`` long together (an
item beyond that is a block), so what is sent to the tasks is bounded.

Nulls and edge cases: a null text has no terms, and documents without terms
neither count nor are found; rows without an id take no part; rows that share a
``doc_id`` are documents of their own, and rows that share an ``item_id`` are
one item; an item without terms, and documents without any of its terms, give no
rows; fewer than ``k`` documents give fewer rows; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import batch_slices, write_table

#: Documents and cells of one treap; bytes of item texts in one block.
TREAP_DOCS, TREAP_CELLS, ITEM_BYTES = 16_384, 2_000_000, 8 << 20

#: Cells of ranges that a step of a search halves together; from so many terms on the lowest ranges go first, which keeps few of them.
STEP_CELLS, MANY_TERMS = 16_384, 1024

#: Bytes of terms, A-Z lower-cased; all other ASCII is a blank.
LETTERS = bytes(
    b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

#: By four-bit map and quadrant: whether it is there, and how many are before it.
THERE = np.array([(m >> q) & 1 for m in range(16) for q in range(4)], dtype=bool)
BEFORE = np.array([bin(m & ((1 << q) - 1)).count("1") for m in range(16) for q in range(4)], dtype=np.int64)
COUNT = np.array([bin(m).count("1") for m in range(16)], dtype=np.int64)

TREAP_SCHEMA = "docs binary, rows int, maps array<binary>, maxima array<binary>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, ids, counts``: a document's terms with repeats, and those in ``terms`` by their number."""
    number = {t: k for k, t in enumerate(terms)}
    size = max(1, len(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batch_slices(whole, 1):
                lengths, found = [], []
                for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    words = terms_of(text)
                    lengths.append(len(words))
                    own = [number[w] for w in words if w in number]
                    found.append(np.array(own, dtype=np.int64) + k * size)
                cells, counts = np.unique(np.concatenate(found), return_counts=True)
                ends = np.searchsorted(cells, np.arange(len(lengths) + 1) * size).astype(np.int32)
                held = np.array(lengths, dtype=np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cells % size, counts)]
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), *lists], names=["doc_id", "n", "ids", "counts"])
                yield out.filter(pa.array(held > 0))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, ids array<int>, counts array<int>")


def document_frequencies(posted: DataFrame, size: int) -> np.ndarray:
    """Of each of ``size`` terms the documents that hold it: sums of each task's counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[held])], names=["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    summed = posted.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # a row a term of the block
        out[r["id"]] = r["n"]
    return out


def build_treap(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, row_bits: int, col_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``maps`` of levels 0 to the last but one and ``maxima`` of all levels, the root's first.

    The bits of rows and of columns are used from the highest down, one of each
    a level; where one kind has run out only the other is split.
    """
    height = max(row_bits, col_bits)
    keys = np.zeros(len(rows), dtype=np.int64)
    for level in range(height):
        keys <<= 2
        if level < row_bits:
            keys |= ((rows >> (row_bits - 1 - level)) & 1) << 1
        if level < col_bits:
            keys |= (cols >> (col_bits - 1 - level)) & 1
    order = np.argsort(keys)
    keys, maxima, maps = keys[order], [impacts[order]], []
    for _ in range(height):
        above = keys >> 2
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(above) else np.zeros(0, dtype=np.int64)
        maps.append(np.bitwise_or.reduceat((1 << (keys & 3)).astype(np.uint8), starts))
        maxima.append(np.maximum.reduceat(maxima[-1], starts))
        keys = above[starts]
    return maps[::-1], maxima[::-1]


def treaps(posted: DataFrame, row_of: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Stored treaps of consecutive documents; ``row_of`` gives each term's row of the grid."""
    row_bits = max(1, (len(row_of) - 1).bit_length())

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        docs, n, held, ids, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(docs, kind="stable")
        place = np.empty(len(docs), dtype=np.int64)
        place[order] = np.arange(len(docs))
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        tf, m = counts.astype(np.int64), np.repeat(m, held)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        maps, maxima = build_treap(row_of[ids], np.repeat(place, held), impacts, row_bits, max(1, (len(docs) - 1).bit_length()))
        less = [maxima[0]] + [np.repeat(up, COUNT[bits]) - own for up, bits, own in zip(maxima, maps, maxima[1:])]
        lists = [[x.astype(kind).tobytes() for x in xs] for xs, kind in ((maps, "u1"), (less, "<i4"))]
        return pa.RecordBatch.from_arrays(
            [pa.array([docs[order].astype("<i8").tobytes()]), pa.array([len(row_of)], pa.int32()), *(pa.array([x], pa.list_(pa.binary())) for x in lists)],
            names=["docs", "rows", "maps", "maxima"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, cells = [], 0, 0
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            doc_ids, n = (batch.column(k).to_numpy() for k in (0, 1))
            ids, counts = (batch.column(k).values.to_numpy() for k in (2, 3))
            at = 0
            while at < batch.num_rows:
                most = np.searchsorted(ends, ends[at] + TREAP_CELLS - cells, side="right") - 1
                end = int(min(batch.num_rows, at + TREAP_DOCS - docs, max(most, at + (not parts))))
                own = slice(ends[at], ends[end])
                if end > at:
                    parts.append((doc_ids[at:end], n[at:end], np.diff(ends[at : end + 1]), ids[own], counts[own]))
                    docs, cells, at = docs + end - at, cells + int(own.stop - own.start), end
                if at < batch.num_rows:
                    yield packed(parts)
                    parts, docs, cells = [], 0, 0
        if parts:
            yield packed(parts)

    return write_table(posted.where("size(ids) > 0").mapInArrow(build, TREAP_SCHEMA), "treaps")


class Treap:
    """A loaded treap: its nodes of all levels one after the other, then one that is empty."""

    def __init__(self, docs: bytes, rows: int, maps: list[bytes], maxima: list[bytes]):
        self.docs = np.frombuffer(docs, dtype="<i8")
        self.row_bits, self.col_bits = max(1, (rows - 1).bit_length()), max(1, (len(self.docs) - 1).bit_length())
        self.height = len(maps)
        bits = [np.frombuffer(m, dtype="u1") for m in maps]
        tops = [np.frombuffer(maxima[0], dtype="<i4").astype(np.int64)]
        for m, less in zip(bits, maxima[1:]):
            tops.append(np.repeat(tops[-1], COUNT[m]) - np.frombuffer(less, dtype="<i4"))
        none = np.zeros(len(tops[-1]) + 1, dtype=np.uint8)
        self.maps = np.concatenate([*bits, none]).astype(np.int64)
        self.tops = np.concatenate([*tops, [0]])
        self.first = np.cumsum(COUNT[self.maps]) - COUNT[self.maps] + 1  # nodes lie in the order of their parents
        self.nothing = len(self.tops) - 1

    def search(self, rows: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """``best`` as (-score, doc_id) in order, with this treap's documents of higher score or smaller id."""
        height, width = self.height, len(rows)
        downs = np.stack([(rows >> max(self.row_bits - 1 - level, 0)) & (level < self.row_bits) for level in range(height)]) * 2
        level, col = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        cells, bound = np.zeros((1, width), dtype=np.int64), np.full(1, self.tops[0] * weights.sum())
        step = max(1, min(256, STEP_CELLS // width))
        while len(bound):
            if len(best) == k:  # what has been found since may rule ranges out
                keep = self._hopeful(bound, level, col, best[-1])
                level, col, cells, bound = level[keep], col[keep], cells[keep], bound[keep]
                if not len(bound):
                    break
            first = np.arange(len(bound))
            if len(bound) > step:
                key = bound if width < MANY_TERMS else bound + level * (int(bound.max()) + 1)
                first = np.argpartition(key, len(key) - step)[-step:]
            taken = level[first], col[first], cells[first]
            rest = np.ones(len(bound), dtype=bool)
            rest[first] = False
            maps, downs_of, firsts = self.maps[taken[2]] * 4, downs[taken[0]], self.first[taken[2]]
            halves = []
            for side in (0, 1):
                quadrant = maps + downs_of + side
                below = np.where(THERE[quadrant], firsts + BEFORE[quadrant], self.nothing)
                total = self.tops[below] @ weights
                split = taken[0] < self.col_bits
                own = (total > 0) & (split | (side == 0))
                halves.append((taken[0][own] + 1, np.where(split, taken[1] * 2 + side, taken[1])[own], below[own], total[own]))
            level, col, cells, bound = (np.concatenate([old[rest], *new]) for old, *new in zip((level, col, cells, bound), *halves))
            done = level == height
            if done.any():
                best = sorted([*best, *zip((-bound[done]).tolist(), self.docs[col[done]].tolist())])[:k]
                level, col, cells, bound = level[~done], col[~done], cells[~done], bound[~done]
        return best

    def _hopeful(self, bound: np.ndarray, level: np.ndarray, col: np.ndarray, last: tuple[int, int]) -> np.ndarray:
        """Ranges that may hold a document before the last place."""
        least = self.docs[col << np.maximum(self.col_bits - level, 0)]
        return (bound > -last[0]) | ((bound == -last[0]) & (least < last[1]))


def _search_block(docs: DataFrame, items: list[tuple[str, list[bytes]]], k: int) -> DataFrame:
    """``item_id, doc_id, score``: each item's best documents of each task."""
    spark = docs.sparkSession
    terms = sorted({t for _, own in items for t in own})
    posted = write_table(postings(docs, terms), "postings")
    counted = posted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = counted["docs"], counted["terms"] or 1
    df = document_frequencies(posted, len(terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    row_of = np.empty(len(terms), dtype=np.int64)
    row_of[np.lexsort((np.arange(len(terms)), df))] = np.arange(len(terms))
    number = {t: n for n, t in enumerate(terms)}
    asked = []
    for name, own in items:
        ids = np.array([number[t] for t in own], dtype=np.int64)
        ids = ids[(weights[ids] > 0) & (df[ids] > 0)]
        if len(ids):
            asked.append((name, row_of[ids], weights[ids]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            for at in range(batch.num_rows):
                treap = Treap(**batch.slice(at, 1).to_pylist()[0])
                for n, (_, rows, own) in enumerate(asked):
                    best[n] = treap.search(rows, own, best[n], k)
        out = [(name, doc, -score) for (name, _, _), found in zip(asked, best) for score, doc in found]
        cols = list(zip(*out)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "doc_id", "score"])

    schema = "item_id string, doc_id long, score long"
    if not asked:
        return spark.createDataFrame([], schema)
    return treaps(posted, row_of, n_docs, n_terms).mapInArrow(search, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``k`` documents of highest score, ties by smaller id."""
    kind = items.schema["item_id"].dataType
    texts = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-held // item_bytes))
    found = []
    for block in range(blocks):
        own: dict[str, set[bytes]] = {}
        for r in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # bounded by item_bytes
            own.setdefault(r["item_id"], set()).update(terms_of(r["text"].encode()))
        found.append(_search_block(docs, [(name, sorted(terms)) for name, terms in sorted(own.items()) if terms], k))
    rows = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
