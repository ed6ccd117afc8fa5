"""Vectorised words and hashes over the UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes, whole texts each, to bound memory.
SLICE_BYTES = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the odd base, or of its inverse, modulo 2**64; grown by doubling."""
    p = _pow[kind]
    base = _ODD if kind == "up" else _ODD_INVERSE
    with np.errstate(over="ignore"):
        while len(p) < n:
            p = np.concatenate([p, p * (p[-1] * base)])
    _pow[kind] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(256, dtype=np.uint64))


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes after lower-casing: digits, a-z and all bytes of characters beyond ASCII.
ALNUM = byte_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Everything but the six white-space characters of ASCII.
NONSPACE = ~byte_table([(0x20, 0x20), (0x09, 0x0D)])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about `limit` bytes of text each."""
    _, at = text_buffer(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 offsets of each text's words."""
    m = is_word[data]
    n = len(m)
    before = np.zeros(n, bool)
    before[1:] = m[:-1]
    after = np.zeros(n, bool)
    after[:-1] = m[1:]
    full = np.flatnonzero(np.diff(at))
    before[at[full]] = False
    after[at[full + 1] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * _powers("up", n), out=total[1:])
        h = (total[ends] - total[starts]) * _powers("down", n + 1)[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingle_hashes(h: np.ndarray, at: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the n + 1 offsets of each text's shingles.

    With `short`, a text with fewer than k words, but not none, has one shingle of all its words.
    """
    counts = np.diff(at)
    n = len(h)
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, n - k + 1), np.uint64)
        if n >= k:
            for j in range(k):
                s += mix(h[j : n - k + 1 + j] + np.uint64(j)) * np.uint64(2 * j + 3)
            s = mix(s)
    firsts = at[:-1]
    keep = np.zeros(len(s) + k, np.int32)
    ok = counts >= k
    np.add.at(keep, firsts[ok], 1)
    np.add.at(keep, firsts[ok] + counts[ok] - k + 1, -1)
    keep = np.cumsum(keep)[: len(s)] > 0
    out_counts = np.where(ok, counts - k + 1, 0)
    out = s[keep]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            extra = np.array([int(_sequence(h[at[i] : at[i + 1]])) for i in few], dtype=np.uint64)
            offsets = np.concatenate([[0], np.cumsum(out_counts)])
            out = np.insert(out, offsets[few], extra)
            out_counts[few] = 1
    return out, np.concatenate([[0], np.cumsum(out_counts)])


def _sequence(h: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        total = np.uint64(len(h))
        for j, x in enumerate(h):
            total = total + mix(np.array([x + np.uint64(j)], np.uint64))[0] * np.uint64(2 * j + 3)
        return mix(np.array([total ^ np.uint64(0xA5A5A5A5)], np.uint64))[0]


def string_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A large_string column from bytes and offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def list_column(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def without(body: bytes, ranges: list[tuple[int, int]]) -> str:
    """UTF-8 bytes without the given sorted, disjoint ranges."""
    edges = [0, *(x for r in ranges for x in r), len(body)]
    return b"".join(body[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)).decode()
