"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Each text is reduced to a short vector of statistics. Standardised, they enter `features` random Fourier features, which
approximate a Gaussian kernel. Every partition sums its part of the normal equations, a matrix of fixed size; the
sums are added in two levels and solved on the driver. Ridge outputs of a separate part of the labelled rows
are summed into a histogram and calibrated by pooling adjacent violators.

Every labelled row outside the held-out fold is used; nothing is sampled. Defined cases: null and empty texts have the statistics
of an empty text and get a score; rows without a label only get scores; a document labelled several times counts with the
mean; with no labels all scores are 0.5; a null doc_id is scored and never learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate
from . import textkit as T
from .spark_util import cut, fold, small_or_shuffled, tree_sum

LOW, HIGH = -0.5, 1.5
_CLASSES = [T.byte_table(r) for r in ([(65, 90)], [(97, 122)], [(48, 57)], [(33, 47), (58, 64), (91, 96), (123, 126)], [(128, 255)], [(10, 10)], [(46, 46), (33, 33), (63, 63)], [(44, 44), (58, 59)], [(35, 38), (42, 43), (60, 62), (64, 64), (94, 94), (124, 124), (126, 126)])]
_LINE = ~T.byte_table([(10, 10)])
N_STATS = len(_CLASSES) + 10


def statistics(texts: pa.RecordBatch) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    raw, at = T.text_buffer(texts.column("text"))
    n, size = texts.num_rows, np.maximum(np.diff(at), 1)
    full = np.flatnonzero(np.diff(at))

    def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out, own = np.zeros(n), np.flatnonzero(np.diff(bounds))
        if len(own):
            out[own] = np.add.reduceat(values, bounds[own], dtype=np.float64)
        return out

    cols = []
    for table in _CLASSES:
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(table[raw].view(np.uint8), at[full], dtype=np.int64)
        cols.append(out / size)
    starts, ends, words = T.word_spans(raw, at, T.NONSPACE)
    h = T.span_hashes(raw, starts, ends)
    count = np.diff(words)
    some = np.maximum(count, 1)
    length = (ends - starts).astype(np.float64)
    mean = per_text(length, words) / some
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    owner = np.repeat(np.arange(n), count)
    distinct = _distinct_counts(owner, h, n)
    pairs = T.mix(h[:-1] ^ T.mix(h[1:])) if len(h) > 1 else np.zeros(0, np.uint64)
    same = owner[:-1] == owner[1:] if len(h) > 1 else np.zeros(0, bool)
    pair_distinct = _distinct_counts(owner[:-1][same], pairs[same], n)
    ls, le, lines = T.word_spans(raw, at, _LINE)
    lh = T.span_hashes(raw, ls, le)
    n_lines = np.diff(lines)
    line_owner = np.repeat(np.arange(n), n_lines)
    cols += [
        np.log1p(np.diff(at)),
        np.log1p(count),
        mean,
        np.sqrt(np.maximum(per_text(length * length, words) / some - mean * mean, 0)),
        per_text(again, words) / some,
        distinct / some,
        pair_distinct / np.maximum(count - 1, 1),
        np.log1p(n_lines),
        _distinct_counts(line_owner, lh, n) / np.maximum(n_lines, 1),
        np.log1p(np.diff(at) / np.maximum(n_lines, 1)),
    ]
    return np.stack(cols, axis=1)


def _distinct_counts(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(np.float64)


class Fourier:
    """Standardisation and random Fourier features, after a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.size = 1 + features

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), np.sqrt(2 / self.w.shape[1]) * np.cos(x @ self.w + self.b)], axis=1)


def _stats_frame(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in statistics(b)], pa.binary())], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats binary")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float64).reshape(-1, N_STATS)


def fit(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, features: int = 512, width: float = 0.7, ridge: float = 0.05, seed: int = 17):
    """(Fourier map, weights, knots) learnt from the labelled rows outside fold `held`; None without any. Of the
    remaining folds the first calibrates and the others fit."""
    calibrates = next(f for f in range(mod) if f != held)
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.avg(label).alias("y"))
    texts = docs.select("doc_id", "text").where(fold("doc_id", mod) != held).join(small_or_shuffled(known.select("doc_id")), "doc_id", "left_semi")
    learn = cut(_stats_frame(texts)).join(small_or_shuffled(known), "doc_id").withColumn("fold", fold("doc_id", mod)).select("stats", "y", "fold")

    def moments(batches):
        total = np.zeros(1 + 2 * N_STATS)
        for b in batches:
            x = _rows(b)
            total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    m = tree_sum(learn.mapInArrow(moments, "part binary"), "part")
    if m is None or m[0] == 0:
        return None
    mean = m[1 : 1 + N_STATS] / m[0]
    phi = Fourier(mean, np.sqrt(np.maximum(m[1 + N_STATS :] / m[0] - mean * mean, 0)), features, width, seed)

    def normal(batches):
        a, v = np.zeros((phi.size, phi.size)), np.zeros(phi.size)
        for b in batches:
            use = np.array(b.column("fold")) != calibrates
            z, y = phi(_rows(b)[use]), np.array(b.column("y"))[use]
            a += z.T @ z
            v += z.T @ y
        yield pa.RecordBatch.from_pydict({"part": pa.array([np.concatenate([a.ravel(), v]).tobytes()], pa.binary())})

    s = tree_sum(learn.mapInArrow(normal, "part binary"), "part")
    a, v = s[: phi.size**2].reshape(phi.size, phi.size), s[phi.size**2 :]
    weights = np.linalg.solve(a + ridge * np.eye(phi.size), v)

    def histogram(batches):
        total = np.zeros((2, calibrate.BINS))
        for b in batches:
            use = np.array(b.column("fold")) == calibrates
            at, y = calibrate.bin_of(phi(_rows(b)[use]) @ weights, LOW, HIGH), np.array(b.column("y"))[use]
            total += np.stack([np.bincount(at, minlength=calibrate.BINS), np.bincount(at, weights=y, minlength=calibrate.BINS)])
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    t = tree_sum(learn.mapInArrow(histogram, "part binary"), "part").reshape(2, -1)
    return phi, weights, calibrate.isotonic(t[0], t[1], LOW, HIGH)


def _score(x: np.ndarray, model) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    phi, weights, knots = model
    return calibrate.apply(phi(x) @ weights, knots, LOW, HIGH)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score): the calibrated chance that `label` is 1."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, mod, held))

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_score(statistics(b), model.value), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", mod) == held).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, held: int = 0) -> DataFrame:
    """`docs` without the rows that score under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "quality", mod, held))

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                yield b.filter(pa.array(_score(statistics(b), model.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
