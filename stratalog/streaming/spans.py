"""Trace spans as streams: the batch relations with event time and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spans import series_keys, symbol


def _timed(spans: DataFrame, late: str) -> DataFrame:
    return spans.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", late)


def stream_series(spans: DataFrame, start_ms: int, size_ms: int, late: str = "1 minute", root: str = "") -> DataFrame:
    """(kind, key, bucket, count, mean) of tumbling buckets from ``start_ms``; a bucket is final once the watermark passes its end.

    Spans before the start, or later than the watermark allows, are dropped.
    """
    keyed = series_keys(spans.where(F.col("start_ms") >= start_ms), root).withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", late)
    shift = start_ms % size_ms
    w = F.window("at", f"{size_ms} milliseconds", startTime=f"{shift} milliseconds")
    grouped = keyed.groupBy(w.alias("w"), "kind", "key").agg(F.count("*").alias("count"), F.floor(F.avg("duration_ms")).cast("bigint").alias("mean"))
    bucket = ((F.unix_millis("w.start") - F.lit(start_ms)) / size_ms).cast("bigint")
    return grouped.select("kind", "key", bucket.alias("bucket"), "count", "mean")


def stream_call_edges(spans: DataFrame, within: str = "10 minutes", late: str = "1 minute", root: str = "") -> DataFrame:
    """(from_file, from_fn, to_file, to_fn, at) of each child span whose parent is a symbol too; a parent starts up to ``within`` before its child.

    Both sides are kept only as long as the watermark and that bound ask for.
    """
    file, fn = symbol(root)
    s = _timed(spans, late).select("span_id", "parent_id", file.alias("file"), fn.alias("fn"), "at").where("file is not null and fn is not null")
    up = s.select(F.col("span_id").alias("up_id"), F.col("file").alias("from_file"), F.col("fn").alias("from_fn"), F.col("at").alias("up_at"))
    down = s.where("parent_id is not null").select("parent_id", F.col("file").alias("to_file"), F.col("fn").alias("to_fn"), "at")
    on = (F.col("parent_id") == F.col("up_id")) & (F.col("at") >= F.col("up_at")) & (F.col("at") <= F.col("up_at") + F.expr(f"interval {within}"))
    return down.join(up, on).select("from_file", "from_fn", "to_file", "to_fn", "at")
