"""Structured Streaming forms of the stateful behaviours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events and cents per type and window; works on a stream and on a table."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def sessions(events: DataFrame, late: str = "1 day", gap: str = "6 hours") -> DataFrame:
    """Sessions of a user that a gap closes."""
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def without_repeats(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark: idempotent ingestion of dropped files."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def overlay_writer(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append each batch's newest row of each key, under its batch id, so that a retry replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != key]
        batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
