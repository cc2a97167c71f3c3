"""Event-time windows, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, by: list[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    """Counts and sums by window; ``late`` sets a watermark for streams."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: list[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    """Runs of events of a key without a pause of ``gap``."""
    e = events.withWatermark(ts, late) if late else events
    grouped = e.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return grouped.select(*by, "first", "last", "n")


def first_events(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
