"""Language of words and texts by a linear-chain conditional random field.

Words are labelled with languages. The score of a label at a word is a sum of learnt weights of the word's features: prefixes and suffixes
of 2 and 3 bytes, all trigrams of bytes, and the word itself (a lexicon), hashed to a fixed number of rows; transitions between the labels of
neighbouring words are learnt with them. Training maximises the conditional likelihood of label sequences, by gradient steps with
forward-backward expectations, on a bounded sample: the `train_docs` learnable documents of up to `train_chars` characters with the smallest
hashes of their id, each word labelled with its document's language. Pieces of several documents are chained now and then, so that switches of language are seen.

A text's words (lower-cased A-Z; maximal runs of a-z and characters beyond ASCII) are labelled with forward-backward over the whole text, all
texts of a slice side by side. A text's scores are the means of its words' probabilities, its language the largest (ties: first in order).

Defined cases: texts that are null or hold no letter are `und` with score 0; texts with letters only outside the words above do not occur; with nothing to learn
from all are `und` with score 0; a null doc_id is predicted and never learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .spark_util import fold

LETTERS = T.byte_table([(0x61, 0x7A), (0x80, 0xFF)])
ROWS = 1 << 16
SLICE = 6_000_000


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature rows of the words [start, end), and the n + 1 offsets of each word's rows."""
    n, size = len(starts), ends - starts
    spans = [(starts, ends), (starts, np.minimum(starts + 2, ends)), (starts, np.minimum(starts + 3, ends)), (np.maximum(ends - 2, starts), ends), (np.maximum(ends - 3, starts), ends)]
    grams = np.maximum(size - 2, 0)
    per = 5 + grams
    at = np.concatenate([[0], np.cumsum(per)])
    gram_word = np.repeat(np.arange(n), grams)
    inside = np.arange(len(gram_word)) - (np.cumsum(grams) - grams)[gram_word]
    gs = starts[gram_word] + inside
    s = np.concatenate([x for x, _ in spans] + [gs])
    e = np.concatenate([y for _, y in spans] + [gs + 3])
    h = T.span_hashes(data, s, e)
    salt = np.concatenate([np.full(n, i, np.uint64) for i in range(5)] + [np.full(len(gs), 5, np.uint64)])
    rows = (T.mix(h + salt * np.uint64(0x1234567)) & np.uint64(ROWS - 1)).astype(np.int64)
    out = np.empty(at[-1], np.int64)
    for i in range(5):
        out[at[:-1] + i] = rows[i * n : (i + 1) * n]
    out[at[gram_word] + 5 + inside] = rows[5 * n :]
    return out, at


def emissions(weights: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    if len(at) < 2:
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[rows], at[:-1], axis=0) / np.diff(at)[:, None] ** 0.5


def forward_backward(emit: np.ndarray, at: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Label probabilities of all positions of the sequences bounded by `at`; with `pairs` also the expected moves.

    Sequences run side by side, longest first, so that step t works on a prefix of them. Each step is normalised.
    """
    count = np.diff(at)
    order = np.argsort(-count, kind="stable")
    count, first = count[order], at[:-1][order]
    labels = emit.shape[1]
    m = np.exp(move)
    p = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
    alpha, beta = np.empty_like(p), np.ones_like(p)
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(longest + 1), side="left")
    a = None
    for t in range(longest):
        k = int(live[t])
        own = first[:k] + t
        a = p[own] if t == 0 else (a[:k] @ m) * p[own]
        a /= a.sum(axis=1, keepdims=True)
        alpha[own] = a
    moves = np.zeros((labels, labels))
    for t in range(longest - 2, -1, -1):
        k = int(live[t + 1])
        own = first[:k] + t
        nxt = p[own + 1] * beta[own + 1]
        b = nxt @ m.T
        if pairs:
            x = alpha[own][:, :, None] * m[None] * nxt[:, None, :]
            moves += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[own] = b / b.sum(axis=1, keepdims=True)
    q = alpha * beta
    q /= q.sum(axis=1, keepdims=True)
    return (q, moves) if pairs else q


#: Fewest training texts of a language, and most languages.
LEAST_DOCS, MOST_LANGUAGES = 20, 2_000


class Field:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((ROWS, len(labels)))
        self.move = np.zeros((len(labels), len(labels)))

    def train(self, texts: list[str], langs: list[str], rounds: int = 3, piece: int = 24, batch: int = 128, rate: float = 0.4, decay: float = 1e-4, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        data, at = T.text_buffer(pa.array(texts, pa.string()))
        data = T.LOWER[data]
        starts, ends, words = T.word_spans(data, at, LETTERS)
        rows, fat = features(data, starts, ends)
        label = np.repeat([self.labels.index(x) for x in langs], np.diff(words))
        pieces = [(int(s), int(min(s + piece, words[i + 1]))) for i in range(len(texts)) for s in range(int(words[i]), int(words[i + 1]), piece)]
        square_w, square_m = np.full(self.weights.shape[0], 1e-2), 1e-2
        for _ in range(rounds):
            mixed = rng.permutation(len(pieces))
            for k in range(0, len(mixed), batch):
                own = [pieces[i] for i in mixed[k : k + batch]]
                pos = np.concatenate([np.arange(s, e) for s, e in own])
                counts = np.array([e - s for s, e in own])
                if len(own) > 8:  # every eighth sequence is chained to the one before it: a switch of language may occur
                    join = np.arange(len(own)) % 8 == 1
                    counts = np.add.reduceat(counts, np.flatnonzero(~join))
                sat = np.concatenate([[0], np.cumsum(counts)])
                per = np.diff(fat)[pos]
                frows = np.concatenate([rows[fat[i] : fat[i + 1]] for i in pos.tolist()])
                rat = np.concatenate([[0], np.cumsum(per)])
                q, moves = forward_backward(emissions(self.weights, frows, rat), sat, self.move, pairs=True)
                y = label[pos]
                grad = -q
                grad[np.arange(len(y)), y] += 1
                inner = np.ones(len(y), bool)
                inner[sat[:-1]] = False
                true = np.zeros_like(moves)
                np.add.at(true, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
                share = np.repeat(grad / per[:, None] ** 0.5, per, axis=0)
                hit, where = np.unique(frows, return_inverse=True)
                g = np.zeros((len(hit), len(self.labels)))
                for c in range(len(self.labels)):
                    g[:, c] = np.bincount(where, weights=share[:, c], minlength=len(hit))
                g = g / len(own) - decay * self.weights[hit]
                square_w[hit] += (g * g).sum(axis=1)
                self.weights[hit] += rate * g / np.sqrt(square_w[hit])[:, None]
                gm = (true - moves) / len(own) - decay * self.move
                square_m += float((gm * gm).sum())
                self.move += rate * gm / np.sqrt(square_m)


def training_rows(docs: DataFrame, mod: int, held: int, train_docs: int, train_chars: int) -> list:
    """About train_docs rows (text, lang), an equal share of each language and of each at least LEAST_DOCS (all it has, if fewer). Thresholds on the
    id's hash, found from ids alone, pick them. More than MOST_LANGUAGES languages raise ValueError: the model keeps a column for each."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(fold("doc_id", mod) != held).where(F.length("text") <= train_chars).withColumn("h", F.xxhash64("doc_id"))
    by_lang = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(by_lang) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not by_lang:
        return []
    share = max(LEAST_DOCS, train_docs // len(by_lang))
    edges = [(r["lang"], min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, share / r["count"])))) for r in by_lang]
    edges = docs.sparkSession.createDataFrame(edges, "lang string, edge long")
    return known.join(F.broadcast(edges), "lang").where("h <= edge").select("text", "lang", "h").collect()


def predict_languages(docs: DataFrame, mod: int = 4, held: int = 2, train_docs: int = 1000, train_chars: int = 20_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, word_share): score is the mean probability of the predicted language, word_share
    the share of words each language is likeliest for."""
    rows = sorted(training_rows(docs.select("doc_id", "text", "lang"), mod, held, train_docs, train_chars), key=lambda r: (r["h"], r["lang"], r["text"]))
    field = Field(sorted({r["lang"] for r in rows}))
    if rows:
        field.train([r["text"] for r in rows], [r["lang"] for r in rows])
    model = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        f = model.value
        for batch in batches:
            for b in T.slices(batch, "text", SLICE):
                n = b.num_rows
                raw, at = T.text_buffer(b.column("text"))
                data = T.LOWER[raw]
                starts, ends, words = T.word_spans(data, at, LETTERS)
                count = np.diff(words)
                letters = np.array(b.column("letters").fill_null(False)) & (count > 0)
                if f.labels and len(starts):
                    _, one, back = np.unique(T.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                    q = forward_backward(emissions(f.weights, *features(data, starts[one], ends[one]))[back], words, f.move)
                    likely = np.zeros_like(q)
                    likely[np.arange(len(q)), q.argmax(axis=1)] = 1
                    total, votes = (np.concatenate([np.zeros((1, q.shape[1])), np.cumsum(x, axis=0)]) for x in (q, likely))
                    mean = (total[words[1:]] - total[words[:-1]]) / np.maximum(count, 1)[:, None]
                    vote = (votes[words[1:]] - votes[words[:-1]]) / np.maximum(count, 1)[:, None]
                    best = mean.argmax(axis=1)
                    lang = [f.labels[i] if ok else "und" for i, ok in zip(best, letters)]
                    score = np.where(letters, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                    share = [[(l, float(v)) for l, v in zip(f.labels, x) if v > 0] if ok else [] for x, ok in zip(vote, letters)]
                else:
                    lang, score, share = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang), pa.array(score), pa.array(share, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "word_share"])

    out = docs.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("letters")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, word_share map<string,double>")
    return out.select("doc_id", (fold("doc_id", mod) == held).alias("held_out"), "lang_pred", "score", "word_share")
