"""Bars from a stream of ticks: the batch aggregation under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.model import step_of


def bars_of_stream(ticks: DataFrame, timeframe: str, keys: list[str], ts: str, price: str, tie: str, late: str = "10 minutes") -> DataFrame:
    """keys, ts_ms, open, high, low, close and tick_volume of each closed bucket; ticks later than `late` are dropped.

    ts is a timestamp. State holds one row a key and open bucket. Buckets begin half a millisecond early, as moments of
    ticks are rounded to milliseconds.
    """
    p = F.col(price).cast("double")
    order = F.when(p.isNotNull(), F.struct(F.col(ts), F.col(tie)))
    b = ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, f"{step_of(timeframe) // 1000} seconds", startTime="-500 microseconds").alias("w")).agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.count(p).cast("double").alias("tick_volume"),
    )
    return b.select(*keys, F.call_function("div", F.unix_micros("w.start") + 500, F.lit(1000)).alias("ts_ms"), "open", "high", "low", "close", "tick_volume")
