"""Tables of ticks as bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import align_down, epoch_ms
from tickloom.model import step_of


def bars_of(ticks: DataFrame, timeframe: str, keys: dict[str, str], ts: str, price: str, tie: str) -> DataFrame:
    """Bars of a tick table straight at a timeframe. keys: new name by column; tie orders ticks of one moment. Ticks without
    a price neither open nor close a bar and are not counted."""
    t = ticks.select(*[F.col(c).alias(k) for c, k in keys.items()], epoch_ms(F.col(ts)).alias("at"), F.col(ts).alias("__ts"), F.col(price).cast("double").alias("p"), F.col(tie).alias("__tie"))
    order = F.when(F.col("p").isNotNull(), F.struct("__ts", "__tie"))
    b = t.withColumn("ts_ms", align_down(F.col("at"), step_of(timeframe)))
    return b.groupBy(*keys.values(), "ts_ms").agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.count("p").cast("double").alias("tick_volume"),
    )
