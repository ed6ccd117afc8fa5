"""Token counts by greedy longest match, in time linear in the text, from an automaton.

The vocabulary is a trie over bytes. Pieces that continue a word and pieces that begin one (marked with a leading byte) have a root each.
Every node has a failure link: the node reached after the longest matched pieces are popped off its string, and the count of pieces
popped on the way. A word walks the trie byte by byte; where no edge fits, the popped count is added and the walk goes on
from the link. No piece is ever built. A byte that no piece starts with counts as one token (byte fallback).

Words are maximal runs of bytes other than ASCII white space; words of a slice walk side by side in NumPy, each distinct word
once. Defined cases: null, empty and blank texts have no tokens; repeated rows each keep their row; a vocabulary
without single bytes still counts every text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as T


class MatchAutomaton:
    """Nodes 0 (root of continuing pieces) and 1 (root of beginning pieces) and the trie below them.

    `begins` holds pieces for the start of a word, `continues` those for the rest.
    """

    def __init__(self, begins: list[bytes], continues: list[bytes]):
        edges: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        parent, depth = [(-1, 0), (-1, 0)], [0, 0]
        for root, pieces in ((1, begins), (0, continues)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in edges[node]:
                        edges[node][byte] = len(edges)
                        edges.append({})
                        ends.append(False)
                        parent.append((node, byte))
                        depth.append(depth[node] + 1)
                    node = edges[node][byte]
                ends[node] = ends[node] or node > 1
        n = len(edges)
        fail, pops = [-1] * n, [0] * n
        for node in sorted(range(2, n), key=depth.__getitem__):
            up, byte = parent[node]
            if ends[node]:
                fail[node], pops[node] = 0, 1
                continue
            if up == 0:
                fail[node], pops[node] = 0, 1  # no piece starts with this byte: fallback
                continue
            # pop what the parent pops, then follow the byte from there; a beginning without a piece starts over at node 0
            at, count = (0, 0) if up == 1 else (fail[up], pops[up])
            while at > 0 and byte not in edges[at]:
                at, count = fail[at], count + pops[at]
            if byte in edges[at]:
                fail[node], pops[node] = edges[at][byte], count
            else:
                fail[node], pops[node] = 0, count + 1
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self._hash_edges(edges)

    def _hash_edges(self, edges: list[dict[int, int]]) -> None:
        """Open addressing: slot -> (node * 256 + byte, target)."""
        keys = np.array([node * 256 + b for node, e in enumerate(edges) for b in e], np.int64)
        targets = np.array([t for e in edges for t in e.values()], np.int64)
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys, self.targets = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        left = np.arange(len(keys))
        step = 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.targets[slot[won]] = targets[left[won]]
            left = left[~won]
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((T.mix(key.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) + step) & self.mask

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Targets of edges, -1 where there is none."""
        key = node * 256 + byte
        out, left = np.full(len(key), -1, np.int64), np.arange(len(key))
        for step in range(self.probes):
            slot = self._slot(key[left], step)
            hit = self.keys[slot] == key[left]
            out[left[hit]] = self.targets[slot[hit]]
            left = left[~hit & (self.keys[slot] >= 0)]
            if not len(left):
                break
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces in each word [start, end) of the bytes."""
        n = len(starts)
        order = np.argsort(starts - ends, kind="stable")
        at, size = starts[order], (ends - starts)[order]
        node, count = np.ones(n, np.int64), np.zeros(n, np.int64)
        longest = int(size[0]) if n else 0
        live_at = np.searchsorted(-size, -np.arange(longest), side="left") if n else []
        for i in range(longest):
            m = int(live_at[i])  # words longer than i
            todo = np.arange(m)
            byte = data[at[:m] + i].astype(np.int64)
            while len(todo):
                target = self.follow(node[todo], byte[todo])
                found = target >= 0
                node[todo[found]] = target[found]
                todo = todo[~found]
                here = node[todo]
                at_root = here == 0
                first = here == 1
                count[todo[at_root]] += 1  # fallback: the byte is a token, the walk stays at the root
                node[todo[first]] = 0  # no beginning piece: go on with continuing pieces
                inner = ~at_root & ~first
                count[todo[inner]] += self.pops[here[inner]]
                node[todo[inner]] = self.fail[here[inner]]
                todo = todo[~at_root]
        rest = np.flatnonzero(node >= 2)
        while len(rest):
            count[rest] += self.pops[node[rest]]
            node[rest] = self.fail[node[rest]]
            rest = rest[node[rest] >= 2]
        out = np.zeros(n, np.int64)
        out[order] = count
        return out


_automata: dict[str, MatchAutomaton] = {}


def automaton(rank_file: str) -> MatchAutomaton:
    """Of a rank file's vocabulary, built once a process: tokens with a leading space begin words, the others continue them."""
    if rank_file not in _automata:
        with open(rank_file, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f]
        _automata[rank_file] = MatchAutomaton([p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "])
    return _automata[rank_file]


def token_counts(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        auto = automaton(rank_file)
        for batch in batches:
            for b in T.slices(batch, "text", 8_000_000):
                data, at = T.text_buffer(b.column("text"))
                starts, ends, words = T.word_spans(data, at, T.NONSPACE)
                _, one, back = np.unique(T.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                n = np.concatenate([[0], np.cumsum(auto.counts(data, starts[one], ends[one])[back])]) if len(starts) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(words), pa.int64()), pa.array(n[words[1:]] - n[words[:-1]], pa.int64()), pa.array(np.diff(at), pa.int64())], ["doc_id", "n_words", "n_tokens", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_bytes long")
