"""Benchmark decontamination with an FM-index per shard of the training texts.

Words are maximal runs of digits, letters a-z and characters beyond ASCII after A-Z are lower-cased. Test phrases are the windows of `window` consecutive words of
each item; an item with fewer words, but not none, is one phrase. Each task cuts its texts into shards of bounded
size, builds a suffix array and from it the Burrows-Wheeler transform in a wavelet matrix, searches all
phrases backward at once, and locates the matches through sampled suffix positions. Overlapping matches merge
into removal spans.

The alphabet of an index is the words of the phrases: any other word ends a run. Runs shorter than
the shortest phrase can hold no match and are left out of the index.

Defined cases: null or word-free texts have no words, hits or items; null or word-free items, and null item ids, match
nothing; repeated items and rows each count, an item id once per text; empty tables give no hits.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .spark_util import cut, small_or_shuffled

#: Phrases searched at once; a larger benchmark is searched in several passes, one after the other, whose hits are united.
PASS_PHRASES = 500_000
SHARD_SYMBOLS = 400_000
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of s, whose last symbol is the unique smallest, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        if step < n:
            nxt[:-step] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = new
        if rank.max() == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, a level per bit."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max()).bit_length())
        self.ones, self.zeros = [], []
        a = symbols
        for b in range(self.levels - 1, -1, -1):
            bit = ((a >> b) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            a = np.concatenate([a[~bit], a[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        lo, hi = np.zeros_like(i), i
        for level, b in enumerate(range(self.levels - 1, -1, -1)):
            ones, z = self.ones[level], self.zeros[level]
            up = ((c >> b) & 1).astype(bool)
            lo, hi = np.where(up, z + ones[lo], lo - ones[lo]), np.where(up, z + ones[hi], hi - ones[hi])
        return hi - lo


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        """symbols: from 1 up; a 0 is added at the end."""
        s = np.concatenate([symbols, [0]])
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.wavelet = WaveletMatrix(self.bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.marked = sa % SAMPLE == 0
        self.sampled = np.where(self.marked, sa, 0)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases, all of one length, by backward search."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.wavelet.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            ok = c < len(self.first) - 1
            lo[live[~ok]] = hi[live[~ok]] = 0
            live, c = live[ok], c[ok]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            done = self.marked[at]
            out[live[done]] = self.sampled[at[done]] + steps[live[done]]
            live, at = live[~done], at[~done]
            c = self.bwt[at]
            rows[live] = self.first[c] + self.wavelet.rank(c, at)
            steps[live] += 1
        return out


def item_words(text: str) -> list[int]:
    data = T.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = T.word_spans(data, np.array([0, len(data)]), T.ALNUM)
    return T.span_hashes(data, starts, ends).tolist()


class Phrases:
    """Distinct phrases over a vocabulary of word hashes, with the items that hold each."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        owners: dict[tuple[int, ...], set] = {}
        for item, words in items:
            if words and item is not None:
                for i in range(max(1, len(words) - window + 1)):
                    owners.setdefault(tuple(words[i : i + window]), set()).add(str(item))
        self.vocabulary = np.array(sorted({w for p in owners for w in p}), np.uint64)
        ids = {int(w): i + 2 for i, w in enumerate(self.vocabulary)}
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == n]
            self.by_length[n] = (np.array([[ids[w] for w in p] for p in own], np.int64), [sorted(owners[p]) for p in own])
        self.shortest = min(self.by_length, default=0)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary symbols from 2 up, or 1 for any other word."""
        if not len(self.vocabulary):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 2, 1)


def shard_hits(sym: np.ndarray, words: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Of a shard's words (texts bounded by the offsets `words`): which are hit, and each text's items."""
    hit, items = np.zeros(len(sym), bool), [set() for _ in range(len(words) - 1)]
    n = len(sym)
    if not n or not phrases.by_length:
        return hit, items
    text = np.repeat(np.arange(len(words) - 1), np.diff(words))
    inside = sym > 1
    fresh = np.ones(n, bool)
    fresh[1:] = ~(inside[1:] & inside[:-1] & (text[1:] == text[:-1]))
    run = np.cumsum(fresh) - 1
    kept = inside & (np.bincount(run)[run] >= phrases.shortest)
    where = np.flatnonzero(kept)
    if not len(where):
        return hit, items
    gap = np.flatnonzero(np.diff(run[where]) > 0) + 1
    seq, origin = np.insert(sym[where], gap, 1), np.insert(where, gap, -1)
    index = FMIndex(seq)
    change = np.zeros(n + 1, np.int64)
    for length, (rows, owners) in phrases.by_length.items():
        lo, hi = index.find(rows)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        counts = (hi - lo)[found]
        ids = np.repeat(found, counts)
        at = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        starts = origin[index.locate(at)]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        for t, p in np.unique(np.stack([text[starts], ids]), axis=1).T.tolist():
            items[t].update(owners[p])
    hit[:] = np.cumsum(change[:-1]) > 0
    return hit, items


def phrase_sets(benchmark: DataFrame, window: int):
    """Phrase sets of about PASS_PHRASES phrases each, one at a time; an empty one for an empty benchmark."""
    own, size, any_ = [], 0, False
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        words = item_words(r["text"])
        own.append((r["item_id"], words))
        size += max(1, len(words) - window + 1)
        if size >= PASS_PHRASES:
            any_ = True
            yield Phrases(own, window)
            own, size = [], 0
    if own or not any_:
        yield Phrases(own, window)


def hits(texts: pa.RecordBatch, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Which words are hit, the n + 1 offsets of each text's words, and each text's items."""
    raw, at = T.text_buffer(texts.column("text"))
    starts, ends, words = T.word_spans(data := T.LOWER[raw], at, T.ALNUM)
    sym, rows, first = phrases.symbols(T.span_hashes(data, starts, ends)), texts.num_rows, 0
    hit, items = np.zeros(len(sym), bool), [set() for _ in range(rows)]
    while first < rows:
        last = max(first + 1, int(np.searchsorted(words, words[first] + SHARD_SYMBOLS, side="right")) - 1)
        part = slice(words[first], words[last])
        hit[part], found = shard_hits(sym[part], words[first : last + 1] - words[first], phrases)
        items[first:last] = found
        first = last
    return hit, words, items


def described(texts: pa.RecordBatch, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
    """n_words, n_hit, spans and cleaned texts of a batch."""
    raw, at = T.text_buffer(texts.column("text"))
    starts, ends, words = T.word_spans(T.LOWER[raw], at, T.ALNUM)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words[1:]] - total[words[:-1]]
    spans, cleaned = [], []
    for i in range(texts.num_rows):
        if not n_hit[i]:
            spans.append([])
            cleaned.append(None)
            continue
        own = np.flatnonzero(hit[words[i] : words[i + 1]]) + words[i]
        cuts = np.flatnonzero(np.diff(own) > 1)
        s, e = own[np.concatenate([[0], cuts + 1])], own[np.concatenate([cuts, [len(own) - 1]])]
        ranges = [(int(starts[x] - at[i]), int(ends[y] - at[i])) for x, y in zip(s, e)]
        body = raw[at[i] : at[i + 1]].tobytes()
        spans.append([{"start": x, "end": y} for x, y in ranges])
        cleaned.append(T.without(body, ranges))
    return np.diff(words), n_hit, spans, cleaned


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, object]:
    """`docs` and a function that gives a slice's hit words and items. A benchmark of one phrase set is broadcast; of a larger one each
    set is broadcast alone, its hits are written and it is released before the next, so no worker ever holds more than one, and
    each row gets what was found as columns under names that no column of docs has."""
    sc = docs.sparkSession.sparkContext
    sets = phrase_sets(benchmark, window)
    first, second = next(sets), next(sets, None)
    if second is None:
        shared = sc.broadcast(first)

        def direct(b):
            hit, _, items = hits(b, shared.value)
            return hit, [sorted(x) for x in items]

        return docs, direct
    mark = uuid.uuid4().hex
    key, other, ranges, found = (f"{c}_{mark}" for c in ("key", "other", "ranges", "items"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).withColumn(other, F.hash("text", "doc_id"))
    parts = None
    for phrases in itertools.chain([first, second], sets):
        shared = sc.broadcast(phrases)

        def run(batches, shared=shared):
            for batch in batches:
                for b in T.slices(batch, "text"):
                    hit, words, items = hits(b, shared.value)
                    rows = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[words]))
                    own = []
                    for i in rows.tolist():
                        at = np.flatnonzero(hit[words[i] : words[i + 1]])
                        cut_ = np.flatnonzero(np.diff(at) > 1)
                        own.append([{"a": int(x), "b": int(y) + 1} for x, y in zip(at[np.concatenate([[0], cut_ + 1])], at[np.concatenate([cut_, [len(at) - 1]])])])
                    pick = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pick), b.column(other).take(pick), pa.array(own, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(items[i]) for i in rows.tolist()], pa.list_(pa.string()))], [key, other, ranges, found])

        more = cut(keyed.select(key, other, "text").mapInArrow(run, f"`{key}` long, `{other}` int, `{ranges}` array<struct<a:long,b:long>>, `{found}` array<string>").dropDuplicates([key, other]))
        shared.destroy()
        parts = more if parts is None else parts.union(more)
    all_ = cut(parts.groupBy(key, other).agg(F.flatten(F.collect_list(ranges)).alias(ranges), F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias(found)))
    joined = keyed.join(small_or_shuffled(all_, F.size(ranges) * 16 + F.size(found) * 32), [key, other], "left").select(*docs.columns, ranges, found)

    def joined_hits(b):
        raw, at = T.text_buffer(b.column("text"))
        starts, _, words = T.word_spans(T.LOWER[raw], at, T.ALNUM)
        change = np.zeros(len(starts) + 1, np.int64)
        for i, own in enumerate(b.column(ranges).to_pylist()):
            for r in own or ():
                change[words[i] + r["a"]] += 1
                change[words[i] + r["b"]] -= 1
        return np.cumsum(change[:-1]) > 0, [x or [] for x in b.column(found).to_pylist()]

    return joined, joined_hits


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, cleaned): the ids as sorted strings; spans are byte ranges
    [start, end) of the UTF-8 text, merged; `cleaned` is the text without them (null where nothing is removed)."""
    rows, look = _found(docs.select("doc_id", "text"), benchmark, window)

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                hit, items = look(b)
                n, n_hit, spans, cleaned = described(b, hit)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(cleaned, pa.string())],
                    ["doc_id", "n_words", "n_hit", "items", "spans", "cleaned"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, cleaned string")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` with the removal spans cut out of their texts; documents that keep no word of a hit text go."""
    rows, look = _found(docs, benchmark, window)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                hit, _ = look(b)
                b = b.select(docs_columns)
                if hit.any():
                    n, n_hit, _, cleaned = described(b, hit)
                    texts = b.column("text").to_pylist()
                    b = b.set_column(place, "text", pa.array([t if c is None else c for t, c in zip(texts, cleaned)], b.column("text").type))
                    b = b.filter(pa.array((n_hit == 0) | (n_hit < n)))
                yield b

    docs_columns = docs.columns
    return rows.mapInArrow(run, docs.schema)
