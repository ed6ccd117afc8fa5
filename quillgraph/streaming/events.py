"""Streams of events and of growing edge lists. The same functions take batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per window; state is dropped once the watermark passes a window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_edges(raw: DataFrame, late: str = "2 hours") -> DataFrame:
    """Canonical edges (src, dst, ts) of a timed edge stream, without loops, each once within the watermark."""
    e = raw.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "ts")
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["src", "dst"]) if raw.isStreaming else e.groupBy("src", "dst").agg(F.min("ts").alias("ts"))


def block_counts(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Running (r, s, m) of a stream of canonical edges against a fixed assignment (v, blk)."""
    from ..operators.blocks import connectivity

    return connectivity(edges, blocks)
