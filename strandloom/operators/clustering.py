"""Clusterers of one block's distinct haplotypes, in NumPy for grouped functions.

All take an r x m matrix of 0/1 alleles and give labels from 0; they are seeded
and ties go to the smaller index.  Blocks of fewer than ``DIRECT`` haplotypes
are not clustered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: distinct haplotypes from which a block is clustered.
DIRECT = 7


def _distances(x: np.ndarray) -> np.ndarray:
    s = np.square(x).sum(axis=1)
    return np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    centers = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([np.square(x - c).sum(axis=1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[0])
    centers = np.array(centers, dtype=float)
    labels = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        new = np.square(x[:, None, :] - centers[None]).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if (new == c).any():
                centers[c] = x[new == c].mean(axis=0)
        if (new == labels).all():
            break
        labels = new
    return labels, centers


def _best_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``starts`` runs the one with the least squared distance to its centres, the first of equal ones."""
    runs = [_kmeans(x, k, rng) for _ in range(starts)]
    return min(runs, key=lambda run: np.square(x - run[1][run[0]]).sum())


def _bic(x: np.ndarray, labels: np.ndarray, centers: np.ndarray) -> float:
    """Bayesian information of a spherical mixture with a shared variance (larger is better)."""
    n, m, k = len(x), x.shape[1], len(centers)
    if n <= k:
        return -np.inf
    var = max(np.square(x - centers[labels]).sum() / (n - k) / m, 1e-9)
    sizes = np.bincount(labels, minlength=k)
    sizes = sizes[sizes > 0]
    fit = (sizes * np.log(sizes)).sum() - n * np.log(n) - n * m / 2 * np.log(2 * np.pi * var) - m * (n - k) / 2
    return fit - (k * (m + 1)) / 2 * np.log(n)


def _assign(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // max(1, centers.size))  # bounds the differences held at once
    parts = [np.square(x[k : k + step, None, :] - centers[None]).sum(axis=2).argmin(axis=1) for k in range(0, len(x), step)]
    return np.concatenate(parts)


def _split_while(x: np.ndarray, rng: np.random.Generator, better, start: int, most: float, starts: int = 1) -> np.ndarray:
    labels, centers = _best_kmeans(x, min(start, len(x)), rng, starts)
    while len(centers) < most:
        made = []
        for c in range(len(centers)):
            own = x[labels == c]
            if len(own) >= 2 and len(centers) + len(made) < most:
                two, halves = _best_kmeans(own, 2, rng, starts)
                if len(set(two.tolist())) == 2 and better(own, two, halves):
                    made.append((c, halves))
        if not made:
            break
        keep = [centers[c] for c in range(len(centers)) if c not in {m[0] for m in made}]
        centers = np.array(keep + [h for _, halves in made for h in halves])
        labels = _assign(x, centers)
    return labels


def xmeans(x: np.ndarray, rng: np.random.Generator, most: int = 30) -> np.ndarray:
    """K-means from two seeds; a cluster splits where that raises the information criterion."""

    def better(own, two, halves):
        return _bic(own, two, halves) > _bic(own, np.zeros(len(own), int), own.mean(axis=0, keepdims=True))

    return _split_while(x, rng, better, 2, most)


def gmeans(x: np.ndarray, rng: np.random.Generator, starts: int = 10, critical: float = 1.8692) -> np.ndarray:
    """K-means; a cluster splits while its projection fails the Anderson-Darling normality test.

    Every split is the best of ``starts`` runs.  The number of clusters has no
    cap: each split lowers the squared distances, so splitting ends.
    """
    from statistics import NormalDist

    def better(own, two, halves):
        axis = halves[0] - halves[1]
        p = own @ axis
        if len(own) < 8 or p.std() == 0:
            return False
        z = np.sort((p - p.mean()) / p.std(ddof=1))
        f = np.clip([NormalDist().cdf(v) for v in z], 1e-12, 1 - 1e-12)
        n = len(z)
        i = np.arange(1, n + 1)
        a2 = -n - np.mean((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1])))
        return a2 * (1 + 4 / n - 25 / n**2) > critical

    return _split_while(x, rng, better, 1, np.inf, starts)


def affinity_propagation(x: np.ndarray, rng: np.random.Generator, damping: float = 0.5, rounds: int = 200, still: int = 15) -> np.ndarray:
    """Exemplars by message passing; without any, each haplotype is its own cluster."""
    n = len(x)
    s = -_distances(x)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if n > 1 else 0)
    s = s + 1e-9 * rng.standard_normal((n, n))
    r, a, held, same = np.zeros((n, n)), np.zeros((n, n)), None, 0
    rows = np.arange(n)
    for _ in range(rounds):
        m = a + s
        best = m.argmax(axis=1)
        top = m[rows, best].copy()
        m[rows, best] = -np.inf
        new = s - top[:, None]
        new[rows, best] = s[rows, best] - m.max(axis=1)
        r = damping * r + (1 - damping) * new
        pos = np.maximum(r, 0)
        pos[rows, rows] = r[rows, rows]
        total = pos.sum(axis=0)
        new = np.minimum(total[None, :] - pos, 0)
        new[rows, rows] = total - pos[rows, rows]
        a = damping * a + (1 - damping) * new
        chosen = tuple(np.flatnonzero((a + r).diagonal() > 0))
        same = same + 1 if chosen == held else 0
        held = chosen
        if same >= still and chosen:
            break
    if not held:
        return np.arange(n)
    heads = np.array(held)
    labels = s[:, heads].argmax(axis=1)
    labels[heads] = np.arange(len(heads))
    return labels if labels.max() > 0 else np.arange(n)


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Ward linkage cut into ``k`` clusters."""
    n = len(x)
    sizes, alive, labels = np.ones(n), np.ones(n, dtype=bool), np.arange(n)
    d = _distances(x.astype(float)) / 2
    np.fill_diagonal(d, np.inf)
    for _ in range(n - max(k, 1)):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        total = sizes[i] + sizes[j] + sizes
        row = ((sizes[i] + sizes) * d[i] + (sizes[j] + sizes) * d[j] - sizes * d[i, j]) / total
        alive[j] = False
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        labels[labels == j] = i
    return np.unique(labels, return_inverse=True)[1]


def _eigengap_ward(x: np.ndarray, affinity: np.ndarray) -> np.ndarray:
    """Number of clusters from the gaps of the normalised Laplacian's spectrum, then Ward."""
    degree = np.maximum(affinity.sum(axis=1), 1e-12)
    scale = 1 / np.sqrt(degree)
    values = np.linalg.eigvalsh(np.eye(len(x)) - affinity * scale[:, None] * scale[None, :])
    return ward(x, min(int(np.diff(values).argmax()) + 2, len(x)))


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]


def knn(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    d = np.sqrt(_distances(x))
    k = min(max(len(x) // 10, 5), len(x) - 1)
    graph = np.zeros_like(d)
    near = _nearest(d, k)
    graph[np.arange(len(x))[:, None], near] = np.take_along_axis(d, near, axis=1)
    return _eigengap_ward(x, np.maximum(graph, graph.T))


def _local_scaling(x: np.ndarray, k: int) -> np.ndarray:
    d = _distances(x)
    own = np.sqrt(np.sort(d, axis=1)[:, min(k, len(x) - 1)])
    scale = np.maximum(own[:, None] * own[None, :], 1e-12)
    out = np.exp(-d / scale)
    np.fill_diagonal(out, 0)
    return out


def local(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return _eigengap_ward(x, _local_scaling(x, max(len(x) // 10, 10)))


def spectral(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    d = _distances(x)
    out = np.exp(-d / max(2 * np.median(d), 1e-12))
    np.fill_diagonal(out, 0)
    return _eigengap_ward(x, out)


def modularity(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Greedy modularity (moves, then aggregation) on the scaled neighbour graph."""
    k = min(max(len(x) // 10, 5), len(x) - 1)
    near = np.zeros((len(x), len(x)), dtype=bool)
    near[np.arange(len(x))[:, None], _nearest(_distances(x), k)] = True
    weights = _local_scaling(x, k) * (near | near.T)
    labels = np.arange(len(x))
    while True:
        n, total = len(weights), weights.sum()
        if total == 0:
            return labels
        degree, own = weights.sum(axis=1), np.arange(n)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in rng.permutation(n):
                links = np.bincount(own, weights=weights[v], minlength=n)
                links[own[v]] -= weights[v, v]
                mass = np.bincount(own, weights=degree, minlength=n)
                mass[own[v]] -= degree[v]
                gain = links - degree[v] * mass / total
                best = int(gain.argmax())
                if gain[best] > gain[own[v]] + 1e-12:
                    own[v], moved, moved_any = best, True, True
        own = np.unique(own, return_inverse=True)[1]
        labels = own[labels]
        if not moved_any:
            return labels
        join = np.eye(own.max() + 1)[own]
        weights = join.T @ weights @ join


CLUSTERERS = {
    "xmeans": xmeans,
    "gmeans": gmeans,
    "affinity_propagation": affinity_propagation,
    "KNN": knn,
    "local": local,
    "modularity": modularity,
    "spectral": spectral,
}


def cluster_haplotypes(distinct: DataFrame, algorithm: str = "xmeans", seed: int = 1) -> DataFrame:
    """``chrom, block_ord, alleles, first_seen, cluster`` with clusters of similar haplotypes.

    A task holds one block's distinct haplotypes, not its samples.  DBSCAN needs
    none: different haplotypes are further apart than its radius, so each is a
    cluster of its own, numbered in the order in which they are first seen.
    """
    if algorithm not in CLUSTERERS and algorithm != "DBSCAN":
        raise ValueError(f"unknown clusterer {algorithm!r}; known: DBSCAN, {', '.join(CLUSTERERS)}")
    if algorithm == "DBSCAN":
        order = Window.partitionBy("chrom", "block_ord").orderBy("first_seen")
        return distinct.select("chrom", "block_ord", "alleles", "first_seen", (F.row_number().over(order) - 1).alias("cluster"))
    clusterer = CLUSTERERS[algorithm]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("first_seen")
        alleles = table.column("alleles").to_pylist()
        labels = np.arange(len(alleles))
        if len(alleles) >= DIRECT:
            x = np.array([[int(c) for c in a] for a in alleles], dtype=float)
            found = clusterer(x, np.random.default_rng([seed, key[1].as_py()]))
            first = {}
            labels = np.array([first.setdefault(c, len(first)) for c in found.tolist()])
        return table.select(["chrom", "block_ord", "alleles", "first_seen"]).append_column("cluster", pa.array(labels, pa.int32()))

    schema = "chrom string, block_ord int, alleles string, first_seen long, cluster int"
    rows = distinct.select("chrom", "block_ord", "alleles", "first_seen")
    return rows.groupBy("chrom", "block_ord").applyInArrow(run, schema)
