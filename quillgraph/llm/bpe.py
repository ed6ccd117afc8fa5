"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split at safe boundaries, where the pre-splitting pattern always ends a match: between a character that is not white
space and white space that follows it. The ids of the parts are then those of the whole text. A text without such a place
stays whole.

Defined cases: null and empty texts have no tokens and decode to no bytes; nothing in a text is read as a special token.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a long text is split at the next safe boundary.
PART_CHARS = 50_000
_BREAK = re.compile(r"(?<=\S)(?=\s)")
_encodings: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, built once a process."""
    import tiktoken

    if (rank_file, pattern) not in _encodings:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[rank_file, pattern]


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    parts, start = [], 0
    while len(text) - start > size:
        m = _BREAK.search(text, start + size)
        if not m:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


def encode(text: str | None, enc) -> list[int]:
    if not text:
        return []
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in enc.encode_ordinary(part)]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded"), group: int = 200) -> DataFrame:
    """doc_id, n_tokens and the outputs asked for: `ids` (array of int), `decoded` (the bytes they decode to), `digests`
    (ids_sha256 over little-endian unsigned 32-bit ids, decoded_sha256 over the decoded bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ("ids" in outputs) + ", decoded binary" * ("decoded" in outputs) + ", ids_sha256 string, decoded_sha256 string" * ("digests" in outputs)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                b = batch.slice(at, group)
                ids = [np.array(encode(t.as_py(), enc), "<u4") for t in b.column("text")]
                cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                decoded = [enc.decode_bytes(x.tolist()) for x in ids] if {"decoded", "digests"} & set(outputs) else []
                if "ids" in outputs:
                    cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
                if "decoded" in outputs:
                    cols["decoded"] = pa.array(decoded, pa.binary())
                if "digests" in outputs:
                    cols["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids])
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decoded])
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
