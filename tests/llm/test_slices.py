"""Texts are hashed in slices whose working arrays stay small; what comes out does not depend on the slices."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillgraph.llm import ngram_join
from quillgraph.llm import textkit as T


def test_hashing_a_batch_takes_little_memory():
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i * 7 + j}" for j in range(300)) for i in range(3000)]})
    whole = ngram_join._sets(batch, 3)[0]
    T._pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
    tracemalloc.start()
    parts = [ngram_join._sets(b, 3)[0] for b in T.slices(batch, "text")]
    peak = tracemalloc.get_traced_memory()[1] - sum(p.nbytes for p in parts)
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(parts), whole) and peak < 40_000_000
