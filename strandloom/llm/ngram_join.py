"""N-gram Jaccard self-join with a prefix tree.

1. Every document becomes the set of its distinct n-word shingles.  Equal sets
   are collapsed to the smallest ``doc_id``.
2. Shingles get one global order: by a bounded sketch of counters (exact up to
   16, then in steps of a tenth, so that very frequent shingles stay apart).  Sets
   that reach the threshold are of one size band or of two neighbouring ones, and
   differ in few shingles.  Cut by hash into more parts than those, two sets have
   equal parts, one of them among the rarest parts of each (:func:`signatures`);
   short sets share one of their rarest shingles instead.  Parts with a shingle
   that occurs once are left out.  Documents that share such a part form candidate
   classes.  A part has several shingles, so that chance brings few texts
   together however many there are.
3. Each class's sets go to one task, which leaves out those with too few shingles
   in common with any other, stores the rest in a prefix tree, frequent shingles
   first so that paths are shared, and walks it for each set outside one chosen
   component, a whole array of nodes at a time.  A class of very many shingles is
   cut into blocks: the first meets each other one, and then what is outside the
   largest component so far meets that and itself, which is little in a group of
   near copies of any size.  Overlap is summed along shared paths; subtrees whose
   sizes cannot reach the threshold are passed over, and so are shingles that only
   one set has.
4. The links of all tasks are joined into components.

A link is decided on all shingles of both sets (64 bits of keyed hashes of their
words), and only links inside one component are left out, so no two linked texts get different classes.

Nulls and edge cases: a text with fewer words than ``n`` is one shingle of all
its words; a text without words, a null text and a null ``doc_id`` link with
nothing; rows that share a ``doc_id`` get the smaller of their classes; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.components import connected_components
from strandloom.llm.hashing import WordHasher, mix, run_hashes, run_starts
from strandloom.llm.shared import MERGED_SKETCHES, SLICE_CHARS, batch_slices, counters_log2, free_worker, id_and_text, remove, sent, sketch_tasks, slices, text_bytes, write_table, written

_BLOCK_LOG2 = 21
_BAND = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_SCAN_SCHEMA = "doc_id long, n_shingles long, high long, low long, block int, counts binary"


class Shingler:
    """Sorted distinct shingle hashes of texts, A-Z lower-cased."""

    def __init__(self, n: int):
        self.n, self._hasher = n, WordHasher(3, lower=True)

    def flat(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sets of all texts one after another, and where each begins (one more at the end)."""
        words, bounds = self._hasher.short(texts)
        many = np.diff(bounds)
        starts = run_starts(bounds, self.n)
        sets = run_hashes(words, self.n)[starts] if len(starts) else words[:0]
        counts = np.maximum(many - self.n + 1, 0)
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            sets[a:b].sort()
        begins = np.concatenate(([0], ends))
        first = np.append(True, sets[1:] != sets[:-1])[: len(sets)]
        first[begins[:-1][counts > 0]] = True
        kept = np.concatenate(([0], np.cumsum(first)))[begins]
        sets = sets[first]
        few = np.flatnonzero((many > 0) & (many < self.n))  # all their words are one shingle
        if not len(few):
            return sets, kept
        whole = [mix(run_hashes(words[a:b], b - a) + np.uint64(b - a)) for a, b in zip(bounds[few].tolist(), bounds[few + 1].tolist())]
        return np.insert(sets, kept[few], np.concatenate(whole)), kept + np.searchsorted(few, np.arange(len(kept)))

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        for cut in slices(texts, 4 * SLICE_CHARS):
            sets, bounds = self.flat(texts[cut])
            yield from (sets[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


class PrefixTree:
    """Compressed prefix tree over integer sets, each sorted by one global order.

    Built from the sets in lexicographic order and the lengths of the prefixes
    that neighbours share.  Node arrays: ``edge`` is a slice of the path of one
    set below the node; ``least``/``most`` bound the sizes of the sets below.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.begin, self.end, self.path, self.kids, self.members = [], [], [], [], []
        self.least, self.most = [], []
        self.root = self._node(0, 0, 0)
        stack = [self.root]
        last: np.ndarray | None = None
        for number in self.order:
            own = sets[number]
            if last is None:
                shared = 0
            else:
                m = min(len(last), len(own))
                differ = np.flatnonzero(last[:m] != own[:m])
                shared = int(differ[0]) if len(differ) else m
            above = None
            while self.end[stack[-1]] > shared:
                above = stack.pop()
            top = stack[-1]
            if self.end[top] < shared:  # split the edge of the last child at this depth
                middle = self._node(self.end[top], shared, self.path[above])
                self.kids[top][-1] = middle
                self.kids[middle].append(above)
                self.begin[above] = shared
                stack.append(middle)
                top = middle
            if len(own) > shared or top == self.root:
                leaf = self._node(shared, len(own), number)
                self.kids[top].append(leaf)
                stack.append(leaf)
                top = leaf
            self.members[top].append(number)
            last = own
        for node in reversed(self._preorder()):
            sizes = [len(sets[self.members[node][0]])] if self.members[node] else []
            self.least[node] = min(sizes + [self.least[k] for k in self.kids[node]], default=0)
            self.most[node] = max(sizes + [self.most[k] for k in self.kids[node]], default=0)

    def _node(self, begin: int, end: int, path: int) -> int:
        self.begin.append(begin)
        self.end.append(end)
        self.path.append(path)
        self.kids.append([])
        self.members.append([])
        self.least.append(0)
        self.most.append(0)
        return len(self.begin) - 1

    def _preorder(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            out.append(todo.pop())
            todo += self.kids[out[-1]]
        return out


class TreeWalk:
    """Overlaps of a set with all sets of a prefix tree, along its shared paths, a whole array of nodes at a time.

    ``shared`` tells which integers are in several sets; others count for no overlap and are left out of the edges.
    """

    def __init__(self, tree: PrefixTree, shared: np.ndarray):
        nodes = tree._preorder()
        at = {node: k for k, node in enumerate(nodes)}
        edges = [tree.sets[tree.path[x]][tree.begin[x] : tree.end[x]] for x in nodes]
        edges = [e[shared[e]] for e in edges]
        self._edges = np.concatenate(edges)
        self._bounds = np.cumsum([0] + [len(e) for e in edges])
        self._sums = np.zeros(len(self._edges) + 1, dtype=np.int32)
        self._stop = np.arange(1, len(nodes) + 1)  # where the subtree of each node ends
        for k in range(len(nodes) - 1, -1, -1):
            for kid in tree.kids[nodes[k]]:
                self._stop[k] = max(self._stop[k], self._stop[at[kid]])
        self._member = np.array([tree.members[x][0] if tree.members[x] else -1 for x in nodes])
        self._size = np.array([tree.end[x] for x in nodes])
        # The root has no edge; what hangs on it is passed over as a whole where its sizes rule it out.
        tops = sorted(at[x] for x in tree.kids[tree.root])
        self._top = np.array(tops, dtype=np.int64)
        self._least, self._most = (np.array([size[nodes[k]] for k in tops], dtype=np.int64) for size in (tree.least, tree.most))

    def linked(self, mark: np.ndarray, size: int, percent: int) -> list[int]:
        """One of each equal sets that reach the threshold with the set of ``size`` integers where ``mark`` is true."""
        near = (self._most * 100 >= size * percent) & (self._least * percent <= size * 100)
        if near.all():
            nodes, begins = slice(None), self._bounds
            edges, stop = self._edges, self._stop
        else:
            begin, end = self._top[near], self._stop[self._top[near]]
            nodes = _ranges(begin, end - begin)
            first, last = self._bounds[begin], self._bounds[end]
            edges = self._edges[_ranges(first, last - first)]
            begins = np.concatenate(([0], np.cumsum(self._bounds[nodes + 1] - self._bounds[nodes])))
            stop = self._stop[nodes] - np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin)
        sums = self._sums[: len(edges) + 1]
        np.cumsum(mark[edges], dtype=np.int32, out=sums[1:])
        gains = np.diff(sums[begins]).astype(np.int64)
        overlap = np.cumsum(gains - np.bincount(stop, gains, len(gains) + 1)[:-1].astype(np.int64))
        member = self._member[nodes]
        return member[(member >= 0) & (overlap * (100 + percent) >= percent * (size + self._size[nodes]))].tolist()


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ...`` of each range, one after another."""
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def linkable_sets(sets: list[np.ndarray], tokens: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets have enough integers in common with others to reach the threshold, and which integers are in several of these.

    What only one set has is in no overlap; a set that goes takes its integers
    with it, so this is looked at again as long as it rules out many.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat, whose, left = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes > 0
    while True:
        shared = np.bincount(flat, minlength=tokens) > 1
        common = np.bincount(whose, shared[flat], len(sets)).astype(np.int64)
        least = np.maximum(-(-sizes * percent // 100), sizes[left].min(initial=1 << 40))
        stays = left & (common * (100 + percent) >= percent * (sizes + least))
        gone, left = int(left.sum() - stays.sum()), stays
        if not gone:
            return left, shared
        kept = left[whose]
        flat, whose = flat[kept], whose[kept]
        if 20 * gone < left.sum():
            return left, np.bincount(flat, minlength=tokens) > 1


def join_classes(
    sets: list[np.ndarray], tokens: int, percent: int, on_link: Callable[[int, int], None] | None = None, labels: list[int] | None = None
) -> list[int]:
    """The class (smallest index) of each set under links of ``percent`` Jaccard.

    Sets of equal ``labels`` are of one class from the start.  One class is chosen
    whose sets need not walk the tree: those outside walk it and meet them.  With
    ``on_link`` all sets walk, and it is told every linked pair, once from each side.
    """
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)

    if labels is not None:
        first: dict[int, int] = {}
        for x, label in enumerate(labels):
            join(first.setdefault(label, x), x)
    left, shared = linkable_sets(sets, tokens, percent) if sets else (np.zeros(0, dtype=bool), None)
    numbers = np.flatnonzero(left).tolist()
    if len(numbers) > 1:
        tree = PrefixTree([sets[x] for x in numbers])
        equal = {}
        for members in tree.members:
            members = [numbers[x] for x in members]
            for x in members:
                equal[x] = members
                join(members[0], x)
        order = [numbers[x] for x in tree.order]
        # The first begins with the most frequent integers, so it is near the middle of a group.
        chosen = order[0] if labels is None else find(first[Counter(labels).most_common(1)[0][0]])
        walk, mark = TreeWalk(tree, shared), np.zeros(tokens, dtype=bool)
        for k, number in enumerate(order):
            if on_link is None and (number != equal[number][0] or (k or labels is not None) and find(number) == find(chosen)):
                continue
            mark[sets[number]] = True
            for other in walk.linked(mark, len(sets[number]), percent):
                other = numbers[other]
                join(number, other)
                if on_link is not None:
                    for x in equal[other]:
                        if x != number:
                            on_link(number, x)
            mark[sets[number]] = False
    return [find(x) for x in range(len(sets))]


def class_links(
    ids: list[int],
    texts: list[str],
    n: int,
    percent: int,
    counted: tuple[list[int], list[bool], list[int]] | None = None,
    labels: list[int] | None = None,
) -> list[tuple[int, int | None, int | None]]:
    """Links of one class of documents: ``(id, smallest id of its component, None)``.

    Documents of equal ``labels`` are known to be of one component.  With ``counted`` (block of each document, whether pairs within that block
    count here, number of its copies) there is ``(id, None, documents linked)``
    for each document as well.
    """
    order = np.argsort(np.array(ids, dtype=np.int64), kind="stable").tolist()
    ids = [ids[k] for k in order]
    sets = list(Shingler(n).sets([texts[k] for k in order]))
    flat = np.concatenate(sets)
    names, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), dtype=np.uint32)
    rank[np.lexsort((names, -counts))] = np.arange(len(names), dtype=np.uint32)
    ranks = np.split(rank[codes], np.cumsum([len(s) for s in sets])[:-1])
    linked, on_link = [0] * len(ids), None
    if counted is not None:
        block, within, copies = ([x[k] for k in order] for x in counted)

        def on_link(x: int, y: int) -> None:
            if block[x] != block[y] or within[x]:
                linked[x] += copies[y]

    labels = labels and [labels[k] for k in order]
    found = join_classes([np.sort(r) for r in ranks], len(names), percent, on_link, labels)
    out = [(ids[k], ids[c], None) for k, c in enumerate(found) if ids[k] != ids[c]]
    return out + [(ids[k], None, m) for k, m in enumerate(linked) if m]


#: What a counter of 0..255 stands for: exact up to 16, then steps of a tenth (up to 10 ** 11).
COUNTER_VALUES = np.where(np.arange(256) <= 16, np.arange(256), 16 * 1.1 ** (np.arange(256) - 16.0))
#: The chance by which one more occurrence raises a counter.
_RISE = np.append(1 / np.diff(COUNTER_VALUES), 0.0)


def count_up(counts: np.ndarray, cells: np.ndarray, rng: np.random.Generator, times: np.ndarray | int = 1) -> None:
    """Count distinct ``cells`` so many times more; never less than two after two calls."""
    held = counts[cells]
    raised = held.astype(np.int64) + times  # exact up to 16
    high = np.flatnonzero(raised > 16)
    if len(high):
        total = COUNTER_VALUES[held[high]] + np.broadcast_to(times, held.shape)[high]
        low = np.minimum(np.searchsorted(COUNTER_VALUES, total, "right") - 1, 254)
        raised[high] = low + (rng.random(len(low)) < (total - COUNTER_VALUES[low]) * _RISE[low])
    counts[cells] = raised


#: The lower counter and the chance of the next one, for the sum of each two.
_SUMS = COUNTER_VALUES[:, None] + COUNTER_VALUES
_SUM_LOW = np.minimum(np.searchsorted(COUNTER_VALUES, _SUMS.ravel(), "right") - 1, 254).astype(np.uint8)
_SUM_OVER = ((_SUMS.ravel() - COUNTER_VALUES[_SUM_LOW]) * _RISE[_SUM_LOW]).astype(np.float32)


def add_counters(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counters of the sums; exact where these are up to 16."""
    both = x.astype(np.uint16) * np.uint16(256) + y
    return _SUM_LOW[both] + (rng.random(len(both), dtype=np.float32) < _SUM_OVER[both])


def size_band(size: int, percent: int) -> int:
    """Sets whose sizes allow a link have the same band or neighbouring ones."""
    step = 1.001 * math.log(100 / percent) if percent < 100 else 1.0
    return int(math.log(size) / step)


#: Smallest sets that are cut into parts; those below share a rare shingle.
LEAST_CUT = 48


def size_borders(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Sizes at which wide bands begin: sets that may link are of one or of neighbouring ones.

    Each spans two factors of ``100 / percent``, so half of all sets have no
    partner in the next one.
    """
    borders = [1]
    while borders[-1] < most and percent < 100:
        borders.append(-(-borders[-1] * 10_000 // (percent * percent)) + 1)
    return np.array(borders)


def signatures(own: np.ndarray, held: np.ndarray, percent: int, borders: np.ndarray) -> np.ndarray:
    """What two different sets that reach the threshold have at least one of in common.

    ``own`` is sorted, ``held`` has the counters.  Linked sets of sizes ``x`` and
    ``y`` differ in ``d = (100 - percent) * (x + y) / (100 + percent)`` shingles
    at most.  Of ``m`` parts, ranges of hashes, ``m - d`` are then equal in both.
    The rarest of these is among the ``d + 1`` rarest of either set, as the others
    come after it in both; so no more than these are told.
    """
    return signatures_of_all(own, np.array([0, len(own)]), held, percent, borders)[0]


def signatures_of_all(sets: np.ndarray, bounds: np.ndarray, held: np.ndarray, percent: int, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of sets that stand one after another, and the number of each one's set."""
    sizes = np.diff(bounds)
    out, whose = [sets[:0]], [np.empty(0, dtype=np.int64)]
    if percent >= 100 or not len(sets):
        return out[0], whose[0]
    most, short = sizes * 100 // percent, np.zeros(len(sizes), dtype=bool)
    own_band = np.searchsorted(borders, sizes, "right")
    # Before each shingle and at the end: sums of hashes, of rarity, and of shingles of one document.
    total = np.zeros((3, len(sets) + 1), dtype=np.uint64)
    for row, values in zip(total, (sets, 256 - held.astype(np.int64), held <= 1)):
        np.cumsum(values, out=row[1:], dtype=np.uint64)
    for band in (own_band, own_band + 1):
        low, high = borders[band - 1], borders[np.minimum(band, len(borders) - 1)]
        differ = (100 - percent) * (sizes + np.minimum(high - 1, most)) // (100 + percent)
        parts = 2 * (100 - percent) * (high - 1) // (100 + percent) + 1
        parts += parts // 4
        here = (sizes > 0) & (most >= low) & (differ > 0)  # no difference: equal sets, which are one already
        cut = (low >= LEAST_CUT) & (2 * parts <= low)
        short |= here & ~cut
        chosen = np.flatnonzero(here & cut)
        if not len(chosen):
            continue
        parts, differ, size = parts[chosen], differ[chosen], sizes[chosen]
        first = np.cumsum(parts) - parts
        shingles = _ranges(bounds[chosen], size)
        part = ((sets[shingles] >> _HALF) * np.repeat(parts.astype(np.uint64), size)) >> _HALF
        filled = np.bincount(part.astype(np.int64) + np.repeat(first, size), minlength=int(parts.sum()))
        after = np.cumsum(filled) + np.repeat(bounds[chosen] - (np.cumsum(size) - size), parts)
        sums, rarity, alone = total[:, after] - total[:, after - filled]
        place, number = _ranges(np.ones(len(parts), dtype=np.int64), parts).astype(np.uint64), np.repeat(np.arange(len(parts)), parts)
        told = mix(mix(sums + place * _BAND) + np.repeat(band[chosen].astype(np.uint64), parts))
        order = np.lexsort((told, rarity, number))
        rarest = order[np.repeat(first + parts, parts) - np.arange(len(order)) <= np.repeat(differ + 1, parts)]
        rarest = rarest[alone[rarest] == 0]
        out.append(told[rarest])
        whose.append(chosen[number[rarest]])
    chosen = np.flatnonzero(short)
    if len(chosen):
        size = sizes[chosen]
        shingles, number = _ranges(bounds[chosen], size), np.repeat(np.arange(len(chosen)), size)
        order = np.lexsort((held[shingles], number))  # ties by hash
        rarest = order[_ranges(np.zeros(len(size), dtype=np.int64), size) < np.repeat(size - -(-percent * size // 100) + 1, size)]
        rarest = rarest[held[shingles[rarest]] > 1]
        narrow, which = np.unique(size, return_inverse=True)
        band = np.array([size_band(x, percent) for x in narrow.tolist()], dtype=np.uint64)[which][number[rarest]]
        for next_one in range(2):  # each shingle once for the set's own narrow band and once for the next
            out.append(mix(sets[shingles[rarest]] + (band + np.uint64(next_one)) * _BAND))
            whose.append(chosen[number[rarest]])
    return np.concatenate(out), np.concatenate(whose)


#: Signatures that a task holds before it hands them on, and bytes of text for each bucket of them.
HELD_SIGNATURES, BUCKET_BYTES = 1 << 20, 64 << 20


def squeezed(values: np.ndarray) -> bytes:
    """Integers of 64 bits, byte by byte so that the equal high ones take no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes())


def expanded(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


def stars(signature: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures in order, the smallest document of each, and ``(document, smallest)`` of the others that have one."""
    order = np.lexsort((doc, signature))
    signature, doc = signature[order], doc[order]
    head = np.append(True, signature[1:] != signature[:-1])[: len(doc)]
    hub = doc[head][np.cumsum(head) - 1]
    pairs = np.unique(np.stack([doc, hub], axis=1)[doc != hub], axis=0)
    return signature[head], doc[head], pairs


_BUCKET_SCHEMA = "bucket int, signatures binary, docs binary, pairs binary"


def dealt_signatures(signature: np.ndarray, doc: np.ndarray, buckets: int, other: int) -> pa.RecordBatch:
    """Rows of ``_BUCKET_SCHEMA``: a signature once, pairs found here as such (in bucket ``other``)."""
    signature, doc, pairs = stars(signature >> np.uint64(16), doc)
    cuts = np.searchsorted((signature * np.uint64(buckets)) >> np.uint64(48), np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for bucket, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b > a:
            rows.append((bucket, squeezed(np.diff(signature[a:b], prepend=np.uint64(0))), squeezed(doc[a:b]), None))
    if len(pairs):
        rows.append((other % buckets, None, None, squeezed(pairs.ravel())))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _BUCKET_SCHEMA.split(", ")])


def _bucket_pairs(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: each document that shares a signature, and the smallest one that has it."""
    made = lambda pairs: pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    held = []
    for batch in parts:
        for row in batch.select(["signatures", "docs", "pairs"]).to_pylist():
            if row["pairs"] is not None:
                yield made(expanded(row["pairs"]).reshape(-1, 2))
            else:
                held.append((np.cumsum(expanded(row["signatures"])), expanded(row["docs"])))
    if held:
        yield made(stars(*map(np.concatenate, zip(*held)))[2])


def _merge_counts(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand, total, rng = zstandard.ZstdDecompressor(), None, np.random.default_rng(key[0].as_py())
    for batch in parts:
        for frame in batch.column("counts").to_pylist():
            more = np.frombuffer(expand.decompress(frame), dtype=np.uint8)
            total = more if total is None else add_counters(total, more, rng)
    made = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([made], pa.binary())], names=["block", "counts"])


def _open_pairs(dealt: DataFrame, settled: DataFrame, block_shingles: int) -> DataFrame:
    """Tasks for pairs of a class that the first block's joins have left open.

    ``dealt`` has ``doc_id, component, weight`` of classes of several blocks,
    ``settled`` their components so far (``node, component``).  Two documents of
    one component need no link between them, so those outside a class's largest
    component meet it and each other, and the largest does not meet itself.  It
    costs as much as a class has outside; of a group of near copies that is
    little, however many they are.
    """
    label = F.coalesce("label", "doc_id")
    rows = dealt.join(settled.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left").withColumn("label", label)
    sums = rows.groupBy("component", "label").agg(F.sum("weight").alias("weight"))
    largest = sums.groupBy("component").agg(F.max(F.struct("weight", (-F.col("label")).alias("minus"))).alias("top"), F.sum("weight").alias("all"))
    half = max(1, block_shingles // 2)
    parts = lambda weight: F.greatest(F.ceil(weight / half), F.lit(1)).cast("long")
    largest = largest.where(F.col("all") > F.col("top.weight")).select(
        "component", (-F.col("top.minus")).alias("main"), parts(F.col("top.weight")).alias("mains"), parts(F.col("all") - F.col("top.weight")).alias("outs")
    )
    rows = write_table(rows.join(largest, "component"), "open")
    own = lambda count: F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("long")
    upto = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    inside = rows.where("label = main").select("doc_id", "component", "label", F.explode(upto("outs")).alias("one"), own("mains").alias("two"))
    out = rows.where("label <> main").withColumn("own", own("outs"))
    across = out.select("doc_id", "component", "label", F.col("own").alias("one"), F.explode(upto("mains")).alias("two"))
    beside = out.withColumn("k", F.explode(upto("outs"))).where("k <> own")
    beside = beside.select("doc_id", "component", "label", F.least("own", "k").alias("one"), (F.col("mains") + F.greatest("own", "k")).alias("two"))
    tasks = inside.unionByName(across).unionByName(beside)
    zero, yes = F.lit(0).cast("long"), F.lit(True)
    return tasks.select("doc_id", "component", zero.alias("own"), F.lit(1).cast("long").alias("copies"), yes.alias("within"), "one", "two", "label")


def ngram_components(
    docs: DataFrame,
    n: int = 3,
    percent: int = 90,
    width_log2: int | None = None,
    most_log2: int = 26,
    block_shingles: int = 1_000_000,
    sketches: int | None = None,
    count_links: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    With ``count_links`` there is ``n_links`` as well: how many other documents
    each one is linked with.  Trees are then walked through; else a walk leaves
    out what already is in a set's class, which near copies in great numbers need.

    The sketch has ``2 ** width_log2`` bytes: the width goes with the bytes of
    text, up to ``most_log2`` (64 MB by default); it orders shingles and decides
    no link.
    """
    rows = id_and_text(docs, id_col, text_col)
    held = text_bytes(rows)
    width_log2 = width_log2 or counters_log2(held, most_log2)
    sketches = sketches or sketch_tasks(docs.sparkSession, held)
    size = 1 << min(_BLOCK_LOG2, width_log2)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        shingler = Shingler(n)
        counts, rng = np.zeros(1 << width_log2, dtype=np.uint8), np.random.default_rng(TaskContext.get().partitionId())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        names = ["doc_id", "n_shingles", "high", "low", "block", "counts"]
        for batch in (part for whole in batches for part in batch_slices(whole, 1, 4 * SLICE_CHARS)):
            sets, bounds = shingler.flat(batch.column(1))
            cells = sets >> np.uint64(64 - width_log2)  # sorted within a set, as it is
            first = np.append(True, cells[1:] != cells[:-1])[: len(cells)]
            first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
            distinct, times = np.unique(cells[first], return_counts=True)
            count_up(counts, distinct, rng, times)
            prints = [np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))[bounds] for x in (sets, mix(sets))]
            out = [batch.column(0), pa.array(np.diff(bounds), pa.int64()), *(pa.array(np.diff(x).view(np.int64)) for x in prints)]
            yield pa.RecordBatch.from_arrays(out + [pa.nulls(batch.num_rows, k) for k in kinds[4:]], names=names)
        squeeze = zstandard.ZstdCompressor(level=1)
        for block in range(len(counts) // size):
            part = counts[block * size : (block + 1) * size]
            if part.any():
                made = (None, None, None, None, block, squeeze.compress(part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], names=names)

    scanned = write_table(rows.coalesce(sketches).mapInArrow(scan, _SCAN_SCHEMA), "shingle-scan")
    own = scanned.where("block is not null").select("block", "counts")
    if sketches > MERGED_SKETCHES:  # a tree of two levels
        part = F.pmod(F.xxhash64("counts"), F.lit(-(-sketches // MERGED_SKETCHES))).alias("part")
        own = own.select("block", part, "counts").groupBy("block", "part").applyInArrow(_merge_counts, "block int, counts binary")
    merged, path = written(own.groupBy("block").applyInArrow(_merge_counts, "block int, counts binary"), "sketch")
    sketch = merged.collect()  # its size is fixed by width_log2
    remove(docs.sparkSession, path)
    shared = docs.sparkSession.sparkContext.broadcast([(r["block"], bytes(r["counts"])) for r in sketch])

    members = scanned.where("block is null").select("doc_id", "n_shingles", "high", "low")
    linkable = members.where("n_shingles > 0 and doc_id is not null")
    heads = linkable.groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    # A table of its own, so that the join with it can split the rows of a set with very many copies.
    heads = write_table(heads, "heads")

    borders, buckets = size_borders(percent), min(1 << 15, max(16, -(-held // BUCKET_BYTES)))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        shingler, expand = Shingler(n), zstandard.ZstdDecompressor()
        counts = np.zeros(1 << width_log2, dtype=np.uint8)
        for block, frame in shared.value:
            counts[block * size : (block + 1) * size] = np.frombuffer(expand.decompress(frame), dtype=np.uint8)
        found, docs, many, other = [], [], 0, TaskContext.get().partitionId()
        for batch in (part for whole in batches for part in batch_slices(whole, 1, 4 * SLICE_CHARS)):
            sets, bounds = shingler.flat(batch.column(1))
            told, whose = signatures_of_all(sets, bounds, counts[sets >> np.uint64(64 - width_log2)], percent, borders)
            found.append(told)
            docs.append(batch.column(0).to_numpy()[whose])
            many += len(told)
            if many >= HELD_SIGNATURES:
                yield dealt_signatures(np.concatenate(found), np.concatenate(docs), buckets, other)
                found, docs, many, other = [], [], 0, other + 1
        if many:
            yield dealt_signatures(np.concatenate(found), np.concatenate(docs), buckets, other)

    known = rows.where("doc_id is not null")
    # A star around each shared signature, never pairs; signatures are moved once, packed, and those of one document end there.
    dealt = known.mapInArrow(postings, _BUCKET_SCHEMA)
    raw = dealt.groupBy("bucket").applyInArrow(_bucket_pairs, "a long, b long").where("a <> b").distinct()
    head_of = linkable.join(heads, ["high", "low", "n_shingles"]).select("doc_id", "head").distinct()
    for side in ("a", "b"):
        raw = raw.join(head_of.withColumnRenamed("doc_id", side), side).drop(side).withColumnRenamed("head", side)
    classes = write_table(connected_components(raw.select("a", "b"), "shingle-classes"), "classes")

    # Only texts of a class are moved.
    candidates = known.join(sent(classes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")

    # Blocks of about as many shingles each, whatever the sizes of the documents.
    weights = linkable.groupBy("doc_id").agg(F.max("n_shingles").alias("weight"))
    classes = classes.withColumnRenamed("node", "doc_id").join(weights, "doc_id")
    sizes = classes.groupBy("component").agg(F.ceil(F.sum("weight") / block_shingles).alias("blocks"))
    dealt = classes.join(sizes, "component").select(
        "doc_id", "component", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("long").alias("own")
    )
    copies = heads.select(F.col("head").alias("doc_id"), "copies")
    if count_links:
        # One task for a class of one block; else one for each pair of blocks.
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("blocks") - 2, F.lit(0))))
        dealt = dealt.withColumn("k", other).withColumn("k", F.when(F.col("k") >= F.col("own"), F.col("k") + 1).otherwise(F.col("k")))
        dealt = dealt.join(copies, "doc_id")
        # Pairs within a block count in one of its tasks: that with the next block.
        within = (F.col("blocks") == 1) | (F.col("k") == (F.col("own") + 1) % F.col("blocks"))
    else:
        # The first block meets each other one; what that leaves open comes after.
        others = F.when((F.col("own") > 0) | (F.col("blocks") == 1), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1))
        dealt = write_table(dealt, "dealt")
        multiple, within = dealt.where("blocks > 1"), F.lit(True)
        dealt = dealt.withColumn("k", F.explode(others)).withColumn("copies", F.lit(1).cast("long"))
    single = F.col("blocks") == 1
    dealt = dealt.select(
        "doc_id",
        "component",
        "own",
        "copies",
        within.alias("within"),
        F.when(single, 0).otherwise(F.least("own", "k")).alias("one"),
        F.when(single, 0).otherwise(F.greatest("own", "k")).alias("two"),
        F.lit(None).cast("long").alias("label"),
    )

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counted = tuple(table.column(c).to_pylist() for c in ("own", "within", "copies")) if count_links else None
        labels = table.column("label").to_pylist()
        found = class_links(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), n, percent, counted, None if None in labels else labels)
        cols = list(zip(*found)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    def joined(dealt: DataFrame) -> DataFrame:
        # Hashed on the side of the few; asked for, so that the plan is alike at every size.
        texts = candidates.join(dealt.hint("shuffle_hash"), "doc_id").select("component", "one", "two", "doc_id", "own", "within", "copies", "label", "text")
        return texts.groupBy("component", "one", "two").applyInArrow(links, "a long, b long, n long")

    found = joined(dealt)
    if not count_links and not multiple.isEmpty():
        found = write_table(found, "first-links")
        rest = _open_pairs(multiple.join(weights, "doc_id"), connected_components(found.select("a", "b"), "first"), block_shingles)
        found = found.unionByName(joined(rest))
    if count_links:
        found = write_table(found, "class-links")
        counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    found = found.where("b is not null").select("a", "b")
    linked = connected_components(found, "links").select(F.col("node").alias("head"), "component")
    placed = head_of.join(linked, "head", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "head")).alias("c"))
    out = members.join(placed, "doc_id", "left")
    extra = []
    if count_links:
        own = head_of.join(copies.withColumnRenamed("doc_id", "head"), "head").join(counts.withColumnRenamed("a", "head"), "head", "left")
        own = own.groupBy("doc_id").agg(F.max(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
        out = out.join(own, "doc_id", "left")
        extra = [F.coalesce("links", F.lit(0)).cast("long").alias("n_links")]
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), *extra)
