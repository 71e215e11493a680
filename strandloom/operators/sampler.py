"""Spike-and-slab Gibbs sampling on sufficient statistics, or on sparse columns.

Every full conditional depends on the data only through n and the Gram matrix of
[1 | y | covariates | haplotypes].  Spark computes that matrix in one pass and
shuffles a copy to each chain's task; a step then costs columns, not samples.
With more than ``gram_columns`` columns, whose square would not fit a task, the
chains get the sparse columns themselves and keep the residuals of the samples:
a step costs the non-zero doses.  Neither way passes through the driver.

A chain's task keeps series of single numbers, and sums of the wide draws by
segment; no draw of all columns leaves it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.posterior import check_geweke
from strandloom.operators.gram import dense_matrix, gram

#: One row for each segment of kept draws; arrays over draws, columns or blocks.
SEGMENTS = (
    "chain int, segment int, iter array<int>, sigma_1 array<double>, sigma_e array<double>, large_ratio array<double>, "
    "n_gamma array<int>, h2 array<double>, alpha array<array<double>>, beta_sum array<double>, beta_square array<double>, "
    "gamma_sum array<bigint>, block_sum array<bigint>, converged boolean, steps bigint, worst_z array<double>"
)


@dataclass
class Settings:
    """Fixed values of the model and run: priors, burn-in, kept draws, limits."""

    s0: float = 0.05
    burn_in: int = 2000
    keep: int = 10_000
    slide: int = 1000
    max_iter: int = 30_000
    z_limit: float = 1.5
    large: float = 0.3
    reject_after: int = 500
    seed: int = 1
    gram_columns: int = 4096


@dataclass
class Statistics:
    """n, and products of y, covariates (c) and haplotypes (h); ``mean_h`` for variances."""

    n: int
    yy: float
    y_sum: float
    cy: np.ndarray
    hy: np.ndarray
    cc: np.ndarray
    ch: np.ndarray
    hh: np.ndarray
    c_sum: np.ndarray
    h_sum: np.ndarray
    annotation: np.ndarray | None = field(default=None)


def long_table(design: DataFrame, phenotype: DataFrame, covariates: DataFrame, c_count: int) -> DataFrame:
    """``sample_idx, column, value`` of [1 | y | C | H]."""
    return (
        phenotype.select("sample_idx", F.lit(0).alias("column"), F.lit(1.0).alias("value"))
        .unionByName(phenotype.select("sample_idx", F.lit(1).alias("column"), F.col("y").alias("value")))
        .unionByName(covariates.select("sample_idx", (F.col("c_idx") + 2).alias("column"), "value"))
        .unionByName(
            design.select("sample_idx", (F.col("hap_ord") + 2 + c_count).alias("column"), F.col("dose").cast("double").alias("value"))
        )
    )


def annotation_matrix(hap_ord: np.ndarray, a_idx: np.ndarray, value: np.ndarray, columns: int) -> np.ndarray:
    out = np.zeros((columns, int(a_idx.max()) + 1))
    out[hap_ord, a_idx] = value
    return out


def gram_statistics(g: np.ndarray, c_count: int, annotation: np.ndarray | None = None) -> Statistics:
    """Statistics from the Gram matrix of [1 | y | C | H]."""
    c, h = slice(2, 2 + c_count), slice(2 + c_count, None)
    parts = (g[c, 1], g[h, 1], g[c, c], g[c, h], g[h, h], g[0, c], g[0, h])
    return Statistics(int(g[0, 0]), g[1, 1], g[0, 1], *(x.copy() for x in parts), annotation)


def geweke_max(x: np.ndarray, first: float = 0.1, last: float = 0.5, intervals: int = 20) -> float:
    """Largest absolute z; equal constant slices give 0."""
    check_geweke(first, last, intervals)
    end = len(x) - 1
    stop = int((1 - last) * end)
    worst = 0.0
    for start in range(0, stop, max(1, int((1 - last) * end / (intervals - 1)))):
        a, b = x[start : start + int(first * (end - start))], x[int(end - last * (end - start)) :]
        if len(a):
            gap, spread = abs(a.mean() - b.mean()), math.sqrt(a.var() + b.var())
            worst = max(worst, gap / spread if spread else (0.0 if gap == 0 else math.inf))
    return worst


#: Coordinates that are drawn together, and what of their products stands before each.
TOGETHER = 48
BEFORE = np.tri(TOGETHER, k=-1)


def _coordinates(products: np.ndarray, residual: np.ndarray, value: np.ndarray, precision: np.ndarray, tau: float, noise: np.ndarray) -> None:
    """One sweep of normal draws; ``residual`` holds X'(y - fit) and follows each change.

    A draw depends linearly on those before it, so a run of coordinates is one
    small lower-triangular system, with the same result as one after the other.
    """
    own = products.diagonal()
    variance = 1.0 / (own * tau + precision)
    scale = variance * tau
    right, pivots = own * value + np.sqrt(variance) * noise / scale, 1 / scale
    for at in range(0, len(value), TOGETHER):
        run = slice(at, at + TOGETHER)
        before = products[run, run]
        before = before * BEFORE[: len(before), : len(before)]
        sums = residual[run] + right[run] + before @ value[run]
        before.flat[:: len(before) + 1] = pivots[run]
        new = np.linalg.solve(before, sums)
        residual -= (new - value[run]) @ products[run]
        value[run] = new


class Chain:
    """State of one chain; :meth:`step` draws every parameter once."""

    def __init__(self, data: Statistics, settings: Settings, chain: int):
        self.d, self.s = data, settings
        self.rng = np.random.default_rng(np.random.SeedSequence(settings.seed, spawn_key=(chain,)))
        p, rng = len(data.hy), self.rng
        self.prior_pi = (1.0, p / (10 if data.annotation is not None else 50))
        var_y, var_h = self._spread()
        self.sigma_0 = math.sqrt(var_y / var_h * settings.s0)
        self.sigma_1 = math.sqrt(1 / rng.gamma(1.0))
        self.sigma_e = math.sqrt(1 / rng.gamma(1.0))
        self.pi = rng.beta(*self.prior_pi)
        self.alpha = rng.random(len(data.cy))
        self.gamma = (rng.random(p) < self.pi).astype(np.int8)
        self.beta = rng.normal(0, np.where(self.gamma == 1, self.sigma_1, self.sigma_0))
        self.theta = None
        if data.annotation is not None:
            self.theta = np.zeros(data.annotation.shape[1])
            self.theta[0] = NormalDist().inv_cdf(min(max(self.pi, 1e-6), 1 - 1e-6))
            self.a_inverse = np.linalg.inv(data.annotation.T @ data.annotation + 1e-9 * np.eye(data.annotation.shape[1]))
            self.a_root = np.linalg.cholesky(self.a_inverse)
        self.refresh()

    def _spread(self) -> tuple[float, float]:
        """Variance of y, and the sum of the variances of the haplotypes."""
        d = self.d
        return d.yy / d.n - (d.y_sum / d.n) ** 2, float((d.hh.diagonal() / d.n - np.square(d.h_sum / d.n)).sum())

    def refresh(self) -> None:
        """Residual products anew, against drift."""
        d = self.d
        self.rh = d.hy - d.ch.T @ self.alpha - d.hh @ self.beta
        self.rc = d.cy - d.cc @ self.alpha - d.ch @ self.beta

    def rss(self) -> float:
        d, a, b = self.d, self.alpha, self.beta
        return max(d.yy - a @ d.cy - b @ d.hy - a @ self.rc - b @ self.rh, 1e-12)

    def h2(self) -> float:
        d, a, b = self.d, self.alpha, self.beta
        hb = b @ (d.hy - d.ch.T @ a - self.rh)
        var_hb = hb / d.n - (d.h_sum @ b / d.n) ** 2
        res = d.yy - 2 * a @ d.cy + a @ d.cc @ a
        return var_hb / (res / d.n - ((d.y_sum - d.c_sum @ a) / d.n) ** 2)

    def _annotated_pi(self) -> np.ndarray:
        """Latent normals by inverse distribution, then regression weights."""
        a, rng, cdf = self.d.annotation, self.rng, NormalDist()
        mean = a @ self.theta
        low = np.array([cdf.cdf(-m) for m in mean])
        u = rng.random(len(mean))
        q = np.where(self.gamma == 1, low + u * (1 - low), u * low)
        z = mean + np.array([cdf.inv_cdf(min(max(x, 1e-12), 1 - 1e-12)) for x in q])
        self.theta = self.a_inverse @ (a.T @ z) + self.a_root @ rng.normal(size=len(self.theta))
        return np.array([cdf.cdf(m) for m in a @ self.theta])

    def _draw_gamma(self, pi) -> None:
        slab = pi / self.sigma_1 * np.exp(-0.5 * np.square(self.beta / self.sigma_1))
        spike = (1 - pi) / self.sigma_0 * np.exp(-0.5 * np.square(self.beta / self.sigma_0))
        odds = np.divide(slab, slab + spike, out=np.full_like(slab, 0.5), where=slab + spike > 0)
        self.gamma = (self.rng.random(len(odds)) < odds).astype(np.int8)

    def step(self) -> None:
        rng, p = self.rng, len(self.beta)
        if self.theta is not None:
            self._draw_gamma(self._annotated_pi())
        on = int(self.gamma.sum())
        self.sigma_1 = math.sqrt(1 / rng.gamma(0.5 * on + 1, 1 / (0.5 * np.square(self.beta) @ self.gamma + 1)))
        if self.sigma_1 < 5 * self.sigma_0:
            self.sigma_1, self.pi = 5 * self.sigma_0, 0.0
        else:
            self.pi = rng.beta(on + self.prior_pi[0], p - on + self.prior_pi[1])
        self.sigma_e = math.sqrt(1 / rng.gamma(self.d.n / 2 + 1, 1 / (self.rss() / 2 + 1)))
        if self.theta is None:
            self._draw_gamma(self.pi)
        tau = self.sigma_e**-2
        self._sweep_alpha(tau, rng.normal(size=len(self.alpha)))
        precision = np.where(self.gamma == 1, self.sigma_1**-2, self.sigma_0**-2)
        self._sweep_beta(precision, tau, rng.normal(size=p))

    def _sweep_alpha(self, tau: float, noise: np.ndarray) -> None:
        before = self.alpha.copy()
        _coordinates(self.d.cc, self.rc, self.alpha, np.zeros(len(before)), tau, noise)
        self.rh -= self.d.ch.T @ (self.alpha - before)

    def _sweep_beta(self, precision: np.ndarray, tau: float, noise: np.ndarray) -> None:
        before = self.beta.copy()
        _coordinates(self.d.hh, self.rh, self.beta, precision, tau, noise)
        self.rc -= self.d.ch @ (self.beta - before)


class SparseData:
    """[1 | y | C | H] by columns: dense y and C, and the samples and doses of each haplotype."""

    def __init__(self, sample: np.ndarray, column: np.ndarray, value: np.ndarray, c_count: int, columns: int, annotation: np.ndarray | None = None):
        names, place = np.unique(sample, return_inverse=True)
        self.n, self.annotation = len(names), annotation
        order = np.argsort(column, kind="stable")
        place, value = place[order], value[order]
        edges = np.searchsorted(column[order], np.arange(columns + 1))
        cut = [(place[a:b], value[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        dense = np.zeros((2 + c_count, self.n))
        for k in range(2 + c_count):
            dense[k, cut[k][0]] = cut[k][1]
        self.y, self.c, self.h = dense[1], dense[2:], cut[2 + c_count :]
        self.norms = np.array([v @ v for _, v in self.h])
        self.hy = np.zeros(len(self.h))  # only its length is asked for
        self.cy = self.c @ self.y


class SparseChain(Chain):
    """The same draws from residuals of the samples, for more columns than a Gram matrix allows."""

    def _spread(self) -> tuple[float, float]:
        sums = np.array([v.sum() for _, v in self.d.h])
        return float(self.d.y.var()), float((self.d.norms / self.d.n - np.square(sums / self.d.n)).sum())

    def refresh(self) -> None:
        self.fit = np.zeros(self.d.n)
        for (at, v), b in zip(self.d.h, self.beta):
            self.fit[at] += b * v
        self.rest = self.d.y - self.alpha @ self.d.c

    def rss(self) -> float:
        return max(float(np.square(self.rest - self.fit).sum()), 1e-12)

    def h2(self) -> float:
        return float(self.fit.var() / self.rest.var())

    def _sweep_alpha(self, tau: float, noise: np.ndarray) -> None:
        left = self.rest - self.fit
        for k, x in enumerate(self.d.c):
            norm = x @ x
            new = (x @ left + norm * self.alpha[k]) / norm + noise[k] / math.sqrt(norm * tau)
            change = (new - self.alpha[k]) * x
            left -= change
            self.rest -= change
            self.alpha[k] = new

    def _sweep_beta(self, precision: np.ndarray, tau: float, noise: np.ndarray) -> None:
        left = self.rest - self.fit
        variance = 1.0 / (self.d.norms * tau + precision)
        sd, scale, norms = np.sqrt(variance) * noise, variance * tau, self.d.norms.tolist()
        for i, (at, v) in enumerate(self.d.h):
            old = self.beta[i]
            new = scale[i] * (v @ left[at] + norms[i] * old) + sd[i]
            left[at] -= (new - old) * v
            self.beta[i] = new
        self.fit = self.rest - left


#: Numbers of draws that a segment holds before they are added up.
HELD_NUMBERS = 1 << 18


class Segment:
    """Kept draws of one stretch: series of numbers, sums of what is wide.

    Draws are added up some hundreds at a time (:meth:`settle`).
    """

    def __init__(self, columns: int, blocks: int):
        self.rows: list[tuple] = []
        self.top: list[np.ndarray] = []
        self.held: list[tuple] = []
        self.beta_sum, self.beta_square = np.zeros(columns), np.zeros(columns)
        self.gamma_sum, self.block_sum = np.zeros(columns, dtype=np.int64), np.zeros(blocks, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.rows) + len(self.held)

    def add(self, it: int, c: Chain, large: float, h2: float, block: np.ndarray) -> None:
        self.held.append((it, c.sigma_1, c.sigma_e, h2, c.alpha.tolist(), c.beta.copy(), c.gamma))
        if len(self.held) * max(1, len(block)) >= HELD_NUMBERS:
            self.settle(large, block)

    def settle(self, large: float, block: np.ndarray) -> None:
        if not self.held:
            return
        its, ones, noises, h2s, alphas, beta, gamma = zip(*self.held)
        beta, gamma = np.array(beta), np.array(gamma)
        size, last = np.abs(beta), min(5, beta.shape[1])
        ratios = (size > large).mean(axis=1).tolist() if last else [math.nan] * len(its)
        self.rows += zip(its, ones, noises, ratios, gamma.sum(axis=1, dtype=np.int64).tolist(), h2s, alphas)
        self.top += list(-np.sort(-np.partition(size, -last, axis=1)[:, -last:], axis=1)) if last else list(size)
        self.beta_sum += beta.sum(axis=0)
        self.beta_square += np.square(beta).sum(axis=0)
        self.gamma_sum += gamma.sum(axis=0, dtype=np.int64)
        if last:
            order = np.argsort(block, kind="stable")
            names, starts = np.unique(block[order], return_index=True)
            self.block_sum[names] += np.maximum.reduceat(gamma[:, order], starts, axis=1).sum(axis=0, dtype=np.int64)
        self.held = []


class Run:
    """A chain under way: :meth:`advance` takes it on, :meth:`state` is all that is needed to go on from here.

    It keeps the segments of the last ``keep`` draws.  Draws with h2 > 1 after
    ``reject_after`` are not counted but move the state; ``max_iter`` bounds the
    steps, so a run always ends.  ``block`` numbers each column's block.
    """

    def __init__(self, data: Statistics | SparseData, settings: Settings, chain: int, block: np.ndarray, state: bytes | None = None):
        self.c = (SparseChain if isinstance(data, SparseData) else Chain)(data, settings, chain)
        self.s, self.block = settings, block
        self.size = len(self.c.beta), int(block.max()) + 1 if len(block) else 0
        self.segments, self.tests = [Segment(*self.size)], []
        self.it = self.kept = self.step = 0
        self.converged = False
        if state is not None:
            own, chain_state, segments = pickle.loads(state)
            vars(self).update(own)
            vars(self.c).update(chain_state)
            self.segments = [Segment(*self.size) for _ in segments]
            for segment, held in zip(self.segments, segments):
                vars(segment).update(held)

    def state(self) -> bytes:
        """Plain numbers and arrays, so that workers need no module of ours to read it."""
        own = {k: getattr(self, k) for k in ("tests", "it", "kept", "step", "converged")}
        return pickle.dumps((own, {k: v for k, v in vars(self.c).items() if k not in ("d", "s")}, [vars(s) for s in self.segments]))

    @property
    def done(self) -> bool:
        return self.converged or self.step >= self.s.max_iter

    def advance(self, steps: int) -> None:
        """Up to so many steps; less where the run ends."""
        c, s, most = self.c, self.s, -(-self.s.keep // self.s.slide)
        for _ in range(steps):
            if self.done:
                break
            self.step += 1
            c.step()
            if self.step % 500 == 0:
                c.refresh()
            h2 = c.h2()
            if self.it > s.reject_after and h2 > 1:
                continue
            if self.it >= s.burn_in:
                if len(self.segments[-1]) == s.slide:
                    self.segments[-1].settle(s.large, self.block)
                    self.segments.append(Segment(*self.size))
                self.segments[-1].add(self.it, c, s.large, h2, self.block)
                self.kept += 1
                if self.kept >= s.keep and (self.kept - s.keep) % s.slide == 0:
                    self.segments = self.segments[-most:]
                    self.segments[-1].settle(s.large, self.block)
                    self.tests.append(worst_z(self.segments))
                    self.converged = self.tests[-1] < s.z_limit
            self.it += 1
        if self.done:
            self.segments = self.segments[-most:]
            self.segments[-1].settle(s.large, self.block)


def run_chain(data: Statistics | SparseData, settings: Settings, chain: int, block: np.ndarray) -> tuple[list[Segment], bool, int, list[float]]:
    """Segments of the last ``keep`` draws, whether they passed the Geweke test, the steps, and each test's worst z."""
    run = Run(data, settings, chain, block)
    run.advance(settings.max_iter)
    return run.segments, run.converged, run.step, run.tests


def worst_z(segments: list[Segment]) -> float:
    """Largest absolute z over every alpha, the five largest effects, their ratio, h2 and sigma_e."""
    rows = [r for s in segments for r in s.rows]
    top = np.array([t for s in segments for t in s.top])
    series = [np.array([r[c] for r in rows]) for c in (3, 5, 2)] + [*np.array([r[6] for r in rows]).T, *top.T]
    return max(geweke_max(x) for x in series)


@dataclass
class Inputs:
    """What the chains' tasks need, and how to read it there."""

    rows: DataFrame
    columns: int
    c_count: int
    sums: bool

    def read(self, table: pa.Table) -> tuple[Statistics | SparseData, np.ndarray]:
        of = {}
        for name in ("data", "block", "annotation"):
            part = table.filter(pc.equal(table.column("kind"), name))
            of[name] = tuple(part.column(x).to_numpy() for x in ("i", "j", "x"))
        block = np.zeros(self.columns - 2 - self.c_count, dtype=np.int64)
        block[of["block"][0]] = of["block"][1]
        extra = annotation_matrix(*of["annotation"], len(block)) if len(of["annotation"][0]) else None
        if self.sums:
            return gram_statistics(dense_matrix(*of["data"], self.columns), self.c_count, extra), block
        return SparseData(*of["data"], self.c_count, self.columns, extra), block


def chain_inputs(
    design: DataFrame, phenotype: DataFrame, covariates: DataFrame, blocks: DataFrame, annotation: DataFrame | None, settings: Settings
) -> Inputs:
    """Rows ``kind, i, j, x``: sums of products (or sparse columns), blocks and annotation."""
    c_count = covariates.agg(F.max("c_idx")).first()[0] + 1
    last = blocks.agg(F.max("hap_ord")).first()[0]
    columns = 2 + c_count + (0 if last is None else last + 1)
    long = long_table(design, phenotype, covariates, c_count)
    sums = columns <= settings.gram_columns
    data = gram(long).select("i", "j", F.col("xy").alias("x")) if sums else long.select(F.col("sample_idx").alias("i"), F.col("column").alias("j"), F.col("value").alias("x"))
    kind = lambda df, name, i, j, x: df.select(F.lit(name).alias("kind"), F.col(i).cast("int").alias("i"), j.cast("int").alias("j"), x.cast("double").alias("x"))
    rows = kind(data, "data", "i", F.col("j"), F.col("x")).unionByName(kind(blocks, "block", "hap_ord", F.col("block_no"), F.lit(0.0)))
    if annotation is not None:
        rows = rows.unionByName(kind(annotation, "annotation", "hap_ord", F.col("a_idx"), F.col("value")))
    return Inputs(rows, columns, c_count, sums)


def segment_batches(chain: int, run: Run) -> Iterator[pa.RecordBatch]:
    """A chain's segments as ``SEGMENTS``."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    kinds = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    for number, s in enumerate(run.segments):
        series = list(zip(*s.rows)) or [()] * 7
        arrays = [pa.array([chain], pa.int32()), pa.array([number], pa.int32()), pa.array([list(series[0])], pa.list_(pa.int32()))]
        arrays += [pa.array([list(series[k])], kinds[k]) for k in range(1, 6)] + [pa.array([list(series[6])], pa.list_(pa.list_(pa.float64())))]
        arrays += [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (s.beta_sum, s.beta_square)]
        arrays += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (s.gamma_sum, s.block_sum)]
        arrays += [pa.array([run.converged]), pa.array([run.step], pa.int64()), pa.array([run.tests], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def sample(
    design: DataFrame,
    phenotype: DataFrame,
    covariates: DataFrame,
    blocks: DataFrame,
    annotation: DataFrame | None = None,
    chains: int = 5,
    settings: Settings | None = None,
) -> DataFrame:
    """``SEGMENTS`` of all chains; a task runs one chain.

    ``blocks`` has ``hap_ord, block_no``.  Each chain's task gets a copy of what
    it needs by a shuffle: sums of products, or sparse columns.
    """
    settings = settings or Settings()
    inputs = chain_inputs(design, phenotype, covariates, blocks, annotation, settings)
    copies = inputs.rows.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).repartitionById(chains, "chain")
    read = Inputs(None, inputs.columns, inputs.c_count, inputs.sums).read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        chain = table.column("chain")[0].as_py()
        own = Run(*_with(read(table), settings, chain))
        own.advance(settings.max_iter)
        yield from segment_batches(chain, own)

    return copies.select("chain", "kind", "i", "j", "x").mapInArrow(run, SEGMENTS)


def _with(read: tuple[Statistics | SparseData, np.ndarray], settings: Settings, chain: int) -> tuple:
    return read[0], settings, chain, read[1]


def draws(segments: DataFrame) -> DataFrame:
    """``chain, iter`` and the single numbers of each kept draw, and its ``alpha``."""
    series = ["iter", "sigma_1", "sigma_e", "large_ratio", "n_gamma", "h2", "alpha"]
    rows = segments.select("chain", F.explode(F.arrays_zip(*series)).alias("x"), "converged")
    return rows.select("chain", *[F.col(f"x.{s}").alias(s) for s in series], "converged")


def column_means(segments: DataFrame) -> DataFrame:
    """``chain, hap_ord, pip, mean, sd`` (population) over each chain's kept draws."""
    zipped = F.arrays_zip("beta_sum", "beta_square", "gamma_sum")
    rows = segments.select("chain", F.size("iter").alias("n"), F.posexplode(zipped).alias("hap_ord", "x"))
    sums = rows.groupBy("chain", "hap_ord").agg(*[F.sum(c).alias(a) for c, a in (("n", "n"), ("x.beta_sum", "s"), ("x.beta_square", "q"), ("x.gamma_sum", "g"))])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("chain", "hap_ord", (F.col("g") / F.col("n")).alias("pip"), mean.alias("mean"), sd.alias("sd"))


def block_means(segments: DataFrame) -> DataFrame:
    """``chain, block_no, pip``: how often any column of the block was in."""
    rows = segments.select("chain", F.size("iter").alias("n"), F.posexplode("block_sum").alias("block_no", "g"))
    return rows.groupBy("chain", "block_no").agg((F.sum("g") / F.sum("n")).alias("pip"))


def chain_log(segments: DataFrame) -> DataFrame:
    """One row a chain: ``steps, kept, converged`` and the worst z of each test, a test every ``slide`` draws."""
    return segments.groupBy("chain").agg(
        F.max("steps").alias("steps"), F.sum(F.size("iter")).alias("kept"), F.max("converged").alias("converged"), F.first("worst_z").alias("worst_z")
    )
