"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value statistics.

Words (lower-cased A-Z; runs of digits, letters and characters beyond ASCII) are counted by class over all labelled learning
texts, once a text. Each word's log-odds between classes is smoothed by a Dirichlet prior: `flat` for each word, and `prior` spread in proportion to its count in both. A word whose log-odds
differs from 0 by `z_min` deviations or more, to either side, scores that log-odds; any other costs `drop`. A linear scan finds all maximal
scoring segments of each whole text. The best segment's score becomes an expected number of such segments by chance
(E = K n exp(-lambda S); lambda from the clean texts' word scores, K fitted on their best segments), and -ln E
is mapped to a chance of the label by isotonic calibration.

No word is left out: a model of up to MODEL_WORDS words is broadcast, a larger one stays a table that the distinct words of the texts
are joined to. Defined cases: null, empty and
word-free texts have no segment and the score of one; a document labelled several times counts with the mean, rounded;
with no labels all scores are 0.5; a null doc_id is scored and never learnt from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate
from . import textkit as T
from .spark_util import cut, fold, small_or_shuffled, tree_sum

LOW, HIGH = -15.0, 85.0
#: Words of a model that is broadcast (16 bytes each).
MODEL_WORDS = 2_000_000


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, in order, by one scan.

    A stack of candidate segments is kept, each with the running total before and after it. A new positive run is
    merged to the left as long as the last candidate that starts at a lower total ends at a lower total. Runs of one sign are first
    folded into one step.
    """
    n = len(score)
    if not n:
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    plus = score > 0
    edge = np.flatnonzero(plus[1:] != plus[:-1]) + 1
    begin = np.concatenate([[0], edge])
    end = np.concatenate([edge, [n]])
    pick = plus[begin]
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest candidate below
    for s, e in zip(begin[pick].tolist(), end[pick].tolist()):
        left, right = float(total[s]), float(total[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((s, e, left, right, j))
                break
            s, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


class Lexicon:
    def __init__(self, words: np.ndarray, odds: np.ndarray, drop: float):
        order = np.argsort(words)
        self.words, self.odds, self.drop = words[order], odds[order], drop
        self.rate, self.offset = 1.0, 0.0

    def scores(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), -self.drop)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.odds[at], -self.drop)

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-ln E of the best segments of texts of n words."""
        return np.where(best > 0, self.rate * best - np.log(np.maximum(n, 1)) - self.offset, LOW)


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, at = T.text_buffer(b.column("text"))
    data = T.LOWER[raw]
    starts, ends, words = T.word_spans(data, at, T.ALNUM)
    return T.span_hashes(data, starts, ends), words, starts, ends, at


def best_segments(h: np.ndarray, words: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, list]:
    s = lexicon.scores(h)
    hot = np.concatenate([[0], np.cumsum(s > 0)])
    best, segments = np.zeros(len(words) - 1), [[] for _ in range(len(words) - 1)]
    for i in np.flatnonzero(hot[words[1:]] > hot[words[:-1]]).tolist():
        segments[i] = maximal_segments(s[words[i] : words[i + 1]])
        best[i] = max(x[2] for x in segments[i])
    return best, segments


def _with_odds(docs: DataFrame, table: DataFrame | None) -> DataFrame:
    """`docs` (with doc_id and text) and, where the model is a table, `model`: the model's words (word, odds) that the text holds."""
    if table is None:
        return docs

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text", 16_000_000):
                h, words, *_ = _words(b)
                owner = np.repeat(np.arange(b.num_rows), np.diff(words))
                own = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(own[0].astype(np.int64))), pa.array(own[1].view(np.int64))], ["key", "word"])

    keyed = docs.withColumn("key", F.xxhash64("text"))
    found = keyed.where("text is not null").select("key", "text").mapInArrow(run, "key long, word long").distinct().join(table, "word")
    return keyed.join(found.groupBy("key").agg(F.collect_list(F.struct("word", "odds")).alias("model")), "key", "left").drop("key")


def _lexicon_of(b: pa.RecordBatch, lexicon: Lexicon) -> Lexicon:
    """The model, or the part of it that the rows bring with them."""
    if "model" not in b.schema.names:
        return lexicon
    flat = b.column("model").flatten()
    words, first = np.unique(flat.field("word").to_numpy().view(np.uint64), return_index=True)
    own = Lexicon(words, flat.field("odds").to_numpy()[first], lexicon.drop)
    own.rate, own.offset = lexicon.rate, lexicon.offset
    return own


def fit(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, prior: float = 500.0, flat: float = 0.5, z_min: float = 3.0, drop: float = 0.15):
    """((Lexicon, knots), table), the table None where the model is broadcast; (None, None) without labelled rows outside fold `held`. Of the remaining folds the last calibrates."""
    calibrates = next(f for f in reversed(range(mod)) if f != held)
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))
    learn = docs.select("doc_id", "text").join(small_or_shuffled(known), "doc_id").withColumn("fold", fold("doc_id", mod)).where(F.col("fold") != held).select("text", "y", "fold")
    learn = cut(learn)

    def count(batches):
        for batch in batches:
            for b in T.slices(batch, "text", 16_000_000):
                h, words, *_ = _words(b)
                y = np.repeat(np.array(b.column("y")), np.diff(words))
                owner = np.repeat(np.arange(b.num_rows), np.diff(words))
                order = np.lexsort((h, owner))
                once = np.ones(len(h), bool)
                once[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                h, y = h[order][once], y[order][once]
                w, at, n = np.unique(h, return_inverse=True, return_counts=True)
                toxic = np.bincount(at, weights=y, minlength=len(w)).astype(np.int64) if len(w) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(toxic), pa.array((n - toxic).astype(np.int64))], ["word", "toxic", "clean"])

    counts = learn.where(F.col("fold") != calibrates).mapInArrow(count, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = cut(counts)
    n_t, n_c = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    a = F.lit(prior) * (F.col("t") + F.col("c")) / F.lit(max(1.0, n_t + n_c))
    t, c = F.col("t") + a + F.lit(flat), F.col("c") + a + F.lit(flat)
    odds = F.log(t / (n_t + prior - t)) - F.log(c / (n_c + prior - c))
    z = odds / F.sqrt(1 / t + 1 / c)
    model = counts.select("word", "c", odds.alias("odds"), z.alias("z")).where((F.col("z") <= -z_min) | ((F.col("z") >= z_min) & (F.col("t") > 0))) if n_t and n_c else counts.select("word", "c", F.lit(0.0).alias("odds")).where("false")
    model = cut(model.select("word", "c", "odds"))
    size = model.count()
    table = model.select("word", "odds") if size > MODEL_WORDS else None
    top = model.select("word", "odds").collect() if table is None else []
    lexicon = Lexicon(np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["odds"] for r in top], float), drop)
    # the clean texts' word scores, in bins: enough for lambda however many words there are
    bins = model.groupBy(F.round("odds", 3).alias("s")).agg(F.sum((F.col("c") + 0.5) / F.lit(max(1.0, n_c))).alias("p")).collect()
    learn = _with_odds(learn, table)
    if size:
        # lambda solves sum p exp(lambda s) = 1 over the clean texts' words
        p, s = np.array([float(r["p"]) for r in bins]), np.array([r["s"] for r in bins])
        low, high = 1e-6, 50.0
        for _ in range(100):
            mid = (low + high) / 2
            grown = float((p * np.exp(np.minimum(mid * s, 700))).sum() + max(0.0, 1 - p.sum()) * math.exp(-mid * drop))
            low, high = (mid, high) if grown < 1 else (low, mid)
        lexicon.rate = low
    sc = docs.sparkSession.sparkContext
    first = sc.broadcast(lexicon)

    def moments(batches):
        total = np.zeros(2)
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, words, *_ = _words(b)
                best, _ = best_segments(h, words, _lexicon_of(b, first.value))
                use = (np.array(b.column("y")) == 0) & (best > 0)
                total += [use.sum(), (first.value.rate * best[use] - np.log(np.diff(words)[use])).sum()]
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    m = tree_sum(learn.where(F.col("fold") == calibrates).mapInArrow(moments, "part binary"), "part")
    # a Gumbel variable with location ln(K n) / lambda has mean (ln(K n) + 0.5772) / lambda
    lexicon.offset = m[1] / m[0] - 0.5772156649 if m is not None and m[0] else 0.0
    second = sc.broadcast(lexicon)

    def histogram(batches):
        total = np.zeros((2, calibrate.BINS))
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, words, *_ = _words(b)
                best, _ = best_segments(h, words, _lexicon_of(b, second.value))
                at = calibrate.bin_of(second.value.evidence(best, np.diff(words)), LOW, HIGH)
                total += np.stack([np.bincount(at, minlength=calibrate.BINS), np.bincount(at, weights=np.array(b.column("y")), minlength=calibrate.BINS)])
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    t = tree_sum(learn.where(F.col("fold") == calibrates).mapInArrow(histogram, "part binary"), "part")
    if t is None:
        return None, None
    return (lexicon, calibrate.isotonic(*t.reshape(2, -1), LOW, HIGH)), table


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, segments): the chance that `label` is 1, and the passages, as UTF-8 byte ranges
    [start, end) with score, whose -ln E is positive."""
    fitted, table = fit(docs, labels, label, mod, held)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, words, starts, ends, at = _words(b)
                if model.value is None:
                    score, found = np.full(b.num_rows, 0.5), [[] for _ in range(b.num_rows)]
                else:
                    lexicon, knots = _lexicon_of(b, model.value[0]), model.value[1]
                    best, segments = best_segments(h, words, lexicon)
                    n = np.diff(words)
                    score = calibrate.apply(lexicon.evidence(best, n), knots, LOW, HIGH)
                    found = [
                        [{"start": int(starts[words[i] + s] - at[i]), "end": int(ends[words[i] + e - 1] - at[i]), "score": x} for s, e, x in own if lexicon.rate * x - math.log(max(1, n[i])) - lexicon.offset > 0]
                        for i, own in enumerate(segments)
                    ]
                spans = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), spans], ["doc_id", "score", "segments"])

    scored = _with_odds(docs.select("doc_id", "text"), table).mapInArrow(run, f"doc_id {kind}, score double, segments array<struct<start:long,end:long,score:double>>")
    return scored.select("doc_id", (fold("doc_id", mod) == held).alias("held_out"), "score", "segments")
