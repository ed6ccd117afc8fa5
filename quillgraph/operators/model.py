"""The block model as one object: assign, fit, release with noise, sample; and the noise behind a release."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gaussian_constant
from . import blocks as B
from . import chain, noise
from .partition import assign


@dataclass
class Release:
    """What may leave: sizes (blk, k), counts (r, s, m), their score if known, and notes. Never the assignment of nodes."""

    sizes: DataFrame
    conn: DataFrame
    nll: float | None = None
    directed: bool = False
    metadata: dict = field(default_factory=dict)

    def sample(self, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """(blocks, edges) of a surrogate graph; the numbers are checked first."""
        return noise.checked_sample(self.sizes.select("blk", F.col("k").cast("long").alias("k")), self.conn, seed, self.directed)


@dataclass
class Noise:
    """Calibrated noise for one release. draw() gives a noisy release."""

    release: Release
    kind: str
    eps: float
    delta: float
    alpha: float
    sensitivity: int
    common: float | None

    @property
    def metadata(self) -> dict:
        out = {"noise": self.kind, **self.release.metadata}
        if self.common is None:
            return {"noise": self.kind, "alpha": self.alpha, "sensitivity": self.sensitivity, "delta_tail": 1 - self.alpha, "eps": self.eps, **self.release.metadata}
        return out | {"sigma_common": self.common}

    def draw(self, seed: int = 0, post: str | None = "naive") -> Release:
        """One noisy release. With different sigmas, `lasso` shrinks and rounds counts, anything else clamps them, and pairs of blocks
        without edges can be lifted; one common sigma cuts counts to integers."""
        size, conn = self.release.sizes, self.release.conn
        if self.common is not None:
            k, m = noise.homogeneous_draw(conn, size, self.common, seed)
            return replace(self.release, sizes=k.select("blk", F.col("k").cast("long").alias("k")), conn=m, nll=None, metadata=self.metadata)
        top = size.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").first()["k"]
        on_size, on_conn = noise.sigmas(conn, size, self.eps, self.delta, self.sensitivity)
        noisy = noise.noisy_counts(conn, on_conn, seed)
        factor: Column = (2 * gaussian_constant(self.eps, self.delta)) ** 2 / F.col("total")
        lasso = str(post).lower() == "lasso"
        kept = noise.lasso(noisy, on_conn, top) if lasso else noise.naive_clamp(noisy, on_conn, size, top, seed)
        lam = noise.activation_threshold() if lasso else 0.0
        lifted = noise.noisy_zero_pairs(conn, size, factor, self.sensitivity, top, seed, lam)
        out = kept.union(lifted)
        k = noise.noisy_sizes(size, on_size, seed)
        if lasso:
            k = size.select("blk", F.lit(top).cast("long").alias("k"))
        else:  # sizes of blocks with counts are the common size
            touched = conn.select(F.explode(F.array("r", "s")).alias("blk")).distinct().withColumn("t", F.lit(True))
            k = k.join(touched, "blk", "left").select("blk", F.when(F.col("t"), F.lit(top)).otherwise(F.col("x").cast("long")).cast("long").alias("k"))
        return replace(self.release, sizes=k, conn=out, nll=None, metadata=self.metadata)


NOISE_KINDS = ("heterogeneous_gaussian", "naive_edge_count_gaussian", "naive_degree_gaussian")


def create_noise(release: Release, eps: float, delta: float, alpha: float, kind: str = "heterogeneous_gaussian") -> Noise:
    """Noise of one of NOISE_KINDS for an undirected release. The sensitivity is the largest quantile of a row's binomials."""
    if release.directed:
        raise NotImplementedError("noise is defined for undirected graphs")
    if kind not in NOISE_KINDS:
        raise ValueError(f"unknown noise {kind!r}")
    sensitivity = int(noise.binomial_quantiles(release.conn, release.sizes, alpha).agg(F.max("c")).first()[0] or 0)
    common = None
    if kind != NOISE_KINDS[0]:
        common = noise.homogeneous_sigma(release.sizes.count(), eps, delta, 1 - alpha, sensitivity)
    return Noise(release, kind, eps, delta, alpha, sensitivity, common)


class Stopping:
    """Decides whether a fit ends; called with the round and the score after it."""

    def should_stop(self, iteration: int, score: float) -> bool:
        raise NotImplementedError


@dataclass
class Patience(Stopping):
    """Ends after `rounds` rounds in a row without a better score."""

    rounds: int
    best: float = float("inf")
    stale: int = 0

    def should_stop(self, iteration: int, score: float) -> bool:
        self.stale = 0 if score < self.best else self.stale + 1
        self.best = min(self.best, score)
        return self.stale >= self.rounds


@dataclass
class AtMost(Stopping):
    """Ends after a number of rounds."""

    rounds: int

    def should_stop(self, iteration: int, score: float) -> bool:
        return iteration >= self.rounds


class BlockModel:
    """A graph (edges, nodes) under blocks of at least k nodes."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, k: int, method: str = "balanced", moves: dict[str, float] | None = None, seed: int = 0):
        unknown = set(moves or {}) - set(chain.PROPOSERS)
        if unknown:
            raise ValueError(f"unknown moves {sorted(unknown)}")
        self.edges, self.nodes, self.k, self.moves, self.seed = edges, nodes, k, moves, seed
        self.start = assign(edges, nodes, k, method)
        self.fitted: chain.Fit | None = None

    def fit(self, rounds: int = 10, mode: str = "strict", temperature: float = 1.0, cooling: float = 0.99, patience: int = 3, stopping: Stopping | None = None) -> chain.Fit:
        self.fitted = chain.fit(self.edges, self.start, rounds, temperature, cooling, mode, self.seed, patience, moves=self.moves, stopping=stopping)
        return self.fitted

    def assignments(self) -> DataFrame:
        """(v, blk), the best found so far."""
        return self.fitted.blocks if self.fitted else self.start

    def release(self, metadata: dict | None = None) -> Release:
        """Sizes, counts and the true best score."""
        if self.fitted is not None:
            return Release(self.fitted.sizes, self.fitted.conn, self.fitted.nll, False, dict(metadata or {}))
        size, conn = B.sizes(self.start), B.connectivity(self.edges, self.start)
        return Release(size, conn, float(B.nll(conn, size).first()[0] or 0.0), False, dict(metadata or {}))
