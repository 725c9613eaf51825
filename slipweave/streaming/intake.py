"""The same operators on arriving data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(records: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first arrival of each content per owner within the watermark on created_at."""
    return records.where(F.col("exact_hash").isNotNull()).withColumn("h", F.lower("exact_hash")).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["user_id", "h"]).drop("h")


def activity(logs: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "3 days") -> DataFrame:
    """Audit rows per window and action; late rows count until the watermark has passed."""
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return logs.withWatermark("created_at", delay).groupBy(w.alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("from_time"), "action", "n")


def sessions(logs: DataFrame, gap: str = "30 minutes", delay: str = "3 days") -> DataFrame:
    """Audit rows per user and session."""
    return logs.withWatermark("created_at", delay).groupBy(F.session_window("created_at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "n")


def run_intake(records: DataFrame, decide: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Decide each micro-batch with `decide` and append it to `out`; processes what is there and stops.

    A batch that is run again after a failure writes to its own folder again, so nothing is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        decide(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
