"""Checks of a stream: completeness by event-time window, and rows without repeated keys, both with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrust.functions.values import absent, col
from tabtrust.operators.checks import kinds


def completeness(stream: DataFrame, ts: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, rows, missing): cells that are null, by window of event time; rows later than the watermark are left out."""
    by = kinds(stream)
    nulls = [absent(col(c), k).cast("long") for c, k in by.items() if c != ts]
    total = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every)).agg(F.count("*").alias("rows"), F.sum(total).alias("missing"))


def without_repeats(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def profile_batches(stream: DataFrame, run, checkpoint: str):
    """Start a query that hands every micro-batch to run(df, batch_id)."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
