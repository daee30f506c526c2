"""A cache of resampled bars: Parquet partitioned by instrument, timeframe and day, and a table of the days' fingerprints.

A day is rebuilt when its file is new, changed or gone, or when VERSION moved on; other days stay as they are. What is
read from the cache is always cut to the range asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.series import day_of
from tickloom.model import DAY
from tickloom.operators.bars import resample, within

VERSION = "1"
KEYS = ["symbol", "side"]


def stale_days(now: DataFrame, before: DataFrame) -> DataFrame:
    """symbol, side and day of what is new, changed or gone between two fingerprint tables."""
    a, b = now.withColumnRenamed("fingerprint", "new"), before.withColumnRenamed("fingerprint", "old")
    return a.join(b, [*KEYS, "day"], "full_outer").filter(~F.col("new").eqNullSafe(F.col("old"))).select(*KEYS, "day")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class BarCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _paths(self, tf: str) -> tuple[str, str]:
        return f"{self.root}/v{VERSION}/bars_{tf}", f"{self.root}/v{VERSION}/days_{tf}"

    def get_or_build(self, minutes: DataFrame, now: DataFrame, tf: str, start_ms: int, end_ms: int) -> DataFrame:
        """Bars of [start, end) at tf; minutes and now (fingerprints) are asked only for the days that are stale."""
        bars, days = self._paths(tf)
        spark = self.spark
        before = spark.read.parquet(days) if _exists(spark, days) else spark.createDataFrame([], "symbol string, side string, day long, fingerprint string")
        asked = (F.col("day") >= start_ms // DAY) & (F.col("day") < -(-end_ms // DAY))
        columns = [*KEYS, "day", "fingerprint"]
        stale = stale_days(now.filter(asked).select(columns), before.filter(asked).select(columns)).persist()
        try:
            if not stale.isEmpty():
                m = minutes.withColumn("day", day_of(F.col("ts_ms"))).join(stale, [*KEYS, "day"], "left_semi").drop("day")
                fresh = resample(m, tf, KEYS).withColumn("day", day_of(F.col("ts_ms")))
                gone = stale.join(now, [*KEYS, "day"], "left_anti")
                write = lambda df, path: df.repartition("symbol", "side", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "side", "day").parquet(path)
                write(fresh, bars)
                write(now.filter(asked).join(stale, [*KEYS, "day"], "left_semi").select(columns).unionByName(gone.withColumn("fingerprint", F.lit("gone"))), days)
        finally:
            stale.unpersist()
        out = spark.read.parquet(bars).filter(asked)
        kept = spark.read.parquet(days).filter(asked & (F.col("fingerprint") != "gone"))
        out = out.withColumn("day", F.col("day").cast("long")).join(kept.select(*KEYS, F.col("day").cast("long").alias("day")), [*KEYS, "day"], "left_semi")
        return within(out.drop("day"), start_ms, end_ms)
