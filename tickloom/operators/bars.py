"""Resampling of bars, range filters and the alignment of two legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import align_down
from tickloom.model import step_of


def within(bars: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Half-open range [start, end)."""
    return bars.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))


def up_to(bars: DataFrame, ts_ms: int) -> DataFrame:
    """The prefix that may be known at ts_ms, inclusive."""
    return bars.filter(F.col("ts_ms") <= ts_ms)


def resample(bars: DataFrame, timeframe: str, keys: list[str]) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume; none for empty buckets; the last
    bucket is kept even if partial; null opens and closes count only if a bucket has no other. One aggregation, which adds up within tasks before it moves rows."""
    step = step_of(timeframe)
    b = bars.withColumn("bucket", align_down(F.col("ts_ms"), step))
    out = b.groupBy(*keys, "bucket").agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts_ms"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts_ms"))).alias("close"), F.sum("tick_volume").alias("tick_volume"),
    )
    return out.withColumnRenamed("bucket", "ts_ms").withColumn("ts_close_ms", F.col("ts_ms") + step)


def aligned(bars: DataFrame, keys: list[str], leg: str, a: str, b: str) -> DataFrame:
    """Both legs' closes at the moments that both have: keys without leg, ts_ms, a and b."""
    rest = [k for k in keys if k != leg]
    left = bars.filter(F.col(leg) == a).select(*rest, "ts_ms", F.col("close").alias("a"))
    right = bars.filter(F.col(leg) == b).select(*rest, "ts_ms", F.col("close").alias("b"))
    return left.join(right, [*rest, "ts_ms"])
