"""Gap detection against the trading calendar, gap policies and continuous sub-ranges.

A gap is a row (keys, start_ms, end_ms, reason); reason is 0 missing_source_file, 1 corrupt_source_file or
2 intra_day_gap, in REASONS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.calendar import is_open
from tickloom.functions.series import align_down, align_up, day_of
from tickloom.model import DAY, MINUTE, step_of

REASONS = ("missing_source_file", "corrupt_source_file", "intra_day_gap")


def open_minutes(spark, start_ms: int, end_ms: int) -> DataFrame:
    """day and ts_ms of every open minute of every date that the window touches."""
    days = spark.range(start_ms // DAY, -(-end_ms // DAY)).select(F.col("id").alias("day"))
    return days.select("day", F.explode(F.sequence(F.col("day") * DAY, F.col("day") * DAY + (DAY - MINUTE), F.lit(MINUTE).cast("long"))).alias("ts_ms")).filter(is_open(F.col("ts_ms")))


def detect(bars: DataFrame, keys: list[str], start_ms: int, end_ms: int, corrupt: DataFrame | None = None, instruments: DataFrame | None = None) -> DataFrame:
    """Gaps of 1-minute bars: a whole day without bars (or in `corrupt`: keys, day) is one gap, else every missing open
    minute is one. Days that are closed throughout are none. Days are looked at whole, not cut to the window."""
    minutes = open_minutes(bars.sparkSession, start_ms, end_ms)
    who = instruments if instruments is not None else bars.select(*keys).distinct()
    days = who.crossJoin(F.broadcast(minutes.select("day").distinct()))  # a day of calendar for each instrument
    b = bars.select(*keys, "ts_ms", day_of(F.col("ts_ms")).alias("day")).filter((F.col("day") >= start_ms // DAY) & (F.col("day") < -(-end_ms // DAY)))
    bad = corrupt.select(*keys, "day").distinct() if corrupt is not None else None
    whole = days.join(b.select(*keys, "day").distinct(), [*keys, "day"], "left_anti").withColumn("reason", F.lit(0))
    if bad is not None:
        whole = whole.join(bad, [*keys, "day"], "left_anti").unionByName(days.join(bad, [*keys, "day"]).withColumn("reason", F.lit(1)))
    part = days.join(whole, [*keys, "day"], "left_anti").join(minutes, "day")
    part = part.join(b.select(*keys, "ts_ms"), [*keys, "ts_ms"], "left_anti")
    return whole.select(*keys, (F.col("day") * DAY).alias("start_ms"), ((F.col("day") + 1) * DAY).alias("end_ms"), "reason").unionByName(
        part.select(*keys, F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + MINUTE).alias("end_ms"), F.lit(2).alias("reason"))
    )


def merged(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that overlap or touch as one; the reason of the lowest order."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    g = gaps.withColumn("reach", F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    g = g.withColumn("island", F.sum(F.when(F.col("start_ms") <= F.col("reach"), 0).otherwise(1)).over(order))
    g = g.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("reason").alias("reason"))
    return g.drop("island")


def of_pair(gaps: DataFrame, keys: list[str], leg: str) -> DataFrame:
    """Gaps of either leg, merged."""
    rest = [k for k in keys if k != leg]
    return merged(gaps.select(*rest, "start_ms", "end_ms", "reason"), rest)


def effective(gaps: DataFrame, keys: list[str], timeframe: str) -> DataFrame:
    """What matters at a timeframe: runs of missing minutes cut to the bars that they cover whole; whole days stay."""
    step = step_of(timeframe)
    runs = merged(gaps.filter("reason = 2"), keys).withColumn("start_ms", align_up(F.col("start_ms"), step)).withColumn("end_ms", align_down(F.col("end_ms"), step))
    return gaps.filter("reason < 2").select(*keys, "start_ms", "end_ms", "reason").unionByName(runs.filter("start_ms < end_ms").select(*keys, "start_ms", "end_ms", "reason"))


def segments(gaps: DataFrame, keys: list[str], instruments: DataFrame, start_ms: int, end_ms: int, timeframe: str) -> DataFrame:
    """The stretches of [start, end) without a gap, in order, snapped inwards to the timeframe: keys, segment, start_ms, end_ms."""
    step = step_of(timeframe)
    m = merged(gaps, keys).filter((F.col("end_ms") > start_ms) & (F.col("start_ms") < end_ms)).select(*keys, "start_ms", "end_ms")
    edge = instruments.select(*keys, F.lit(end_ms).cast("long").alias("start_ms"), F.lit(end_ms).cast("long").alias("end_ms"))
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    s = m.unionByName(edge).withColumn("from_ms", F.coalesce(F.lag("end_ms").over(w), F.lit(start_ms)))
    s = s.select(*keys, align_up(F.greatest(F.col("from_ms"), F.lit(start_ms)), step).alias("from_ms"), align_down(F.least(F.col("start_ms"), F.lit(end_ms)), step).alias("to_ms")).filter("from_ms < to_ms")
    return s.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("from_ms")).alias("segment"), F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"))


def aborted(gaps: DataFrame, keys: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """keys and n_gaps of the instruments that the strict policy refuses: those with a gap within the window."""
    g = gaps.filter((F.col("end_ms") > start_ms) & (F.col("start_ms") < end_ms))
    return g.groupBy(*keys).agg(F.count("*").alias("n_gaps"))


def segmented(bars: DataFrame, keys: list[str], parts: DataFrame) -> DataFrame:
    """Bars with the segment that holds them; bars within gaps are left out. Bars and segment starts are put in one
    order, so no range join is needed."""
    both = bars.select(*keys, "ts_ms", F.struct(*[c for c in bars.columns if c not in keys]).alias("bar"), F.lit(1).alias("kind"))
    marks = parts.select(*keys, F.col("start_ms").alias("ts_ms"), F.struct("segment", "end_ms").alias("part"), F.lit(0).alias("kind"))
    w = Window.partitionBy(*keys).orderBy("ts_ms", "kind").rowsBetween(Window.unboundedPreceding, 0)
    b = both.unionByName(marks, allowMissingColumns=True).withColumn("part", F.last("part", ignorenulls=True).over(w))
    return b.filter((F.col("kind") == 1) & (F.col("ts_ms") < F.col("part.end_ms"))).select(*keys, F.col("part.segment").alias("segment"), "bar.*")


def reason_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in REASONS]), code + 1)
