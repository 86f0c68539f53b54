"""Sketches over event-time windows: mergeable aggregates under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_of(ts: str, size: str, slide: str | None = None, gap: str | None = None) -> Column:
    """Tumbling, sliding (with ``slide``) or session (with ``gap``)."""
    return F.session_window(ts, gap) if gap else F.window(ts, size, slide or size)


def windowed(events: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], *, delay: str = "10 minutes", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """keys, start, end and the aggregates of each window; rows later than ``delay`` are dropped. Batch or stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = rows.groupBy(window_of(ts, size, slide, gap).alias("_w"), *keys).agg(*aggregates)
    kept = [c for c in out.columns if c not in ("_w", *keys)]
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *kept)


def hll(col: str, p: int = 14) -> Column:
    return F.hll_sketch_agg(col, p).alias("sketch")


def count_min(col: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 42) -> Column:
    return F.count_min_sketch(F.col(col), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("counts")


def top_k(col: str, k: int = 10, tracked: int = 10_000) -> Column:
    return F.expr(f"approx_top_k(`{col}`, {int(k)}, {int(tracked)})").alias("top")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is available now, appended to Parquet files; the checkpoint makes it go on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
