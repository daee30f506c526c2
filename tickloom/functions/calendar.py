"""The trading calendar: open from Sunday 22:00 to Friday 22:00 UTC, closed all of 25 December and 1 January."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import date_of, hour_of, weekday_of
from tickloom.model import DAY, HOUR


def is_open(ms: Column) -> Column:
    d, day, hour = date_of(ms), weekday_of(ms), hour_of(ms)
    holiday = ((F.month(d) == 12) & (F.dayofmonth(d) == 25)) | ((F.month(d) == 1) & (F.dayofmonth(d) == 1))
    return ~holiday & ((day <= 3) | ((day == 4) & (hour < 22)) | ((day == 6) & (hour >= 22)))


def month_edge_days(span: DataFrame, cutoff: int) -> DataFrame:
    """day (since 1970) and bucket (EOM-k or SOM-k; the end of the month wins) for the trading days at the edges of the
    months that span (one row: first day a, last day b) touches. A trading day is one whose noon is open."""
    first = F.unix_date(F.trunc(F.date_from_unix_date(F.col("a").cast("int")), "month"))
    last = F.unix_date(F.last_day(F.date_from_unix_date(F.col("b").cast("int"))))
    days = span.filter("a IS NOT NULL").select(F.explode(F.sequence(first, last)).alias("day")).select(F.col("day").cast("long").alias("day"))
    days = days.filter(is_open(F.col("day") * DAY + 12 * HOUR)).withColumn("month", F.trunc(F.date_from_unix_date(F.col("day").cast("int")), "month"))
    up = F.row_number().over(Window.partitionBy("month").orderBy("day"))
    down = F.row_number().over(Window.partitionBy("month").orderBy(F.col("day").desc()))
    days = days.select("day", up.alias("up"), down.alias("down"))
    label = F.when(F.col("down") <= cutoff, F.concat(F.lit("EOM-"), F.col("down"))).when(F.col("up") <= cutoff, F.concat(F.lit("SOM-"), F.col("up")))
    return days.select("day", label.alias("bucket")).filter("bucket IS NOT NULL")
