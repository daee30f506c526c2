"""Day files: <root>/<SYMBOL>/<YYYY>/<MM, from 00>/<DD>_<bid|ask>.csv.zst, a header and one row a minute.

Files are read as bytes by Spark, so a corrupt one is a row with an error and not the end of the job; the same bytes
give the file's fingerprint. Only the months' folders that a range touches are listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.model import DAY, SIDES

PATH = re.compile(r"([^/]+)/(\d{4})/(\d{2})/(\d{2})_(bid|ask)\.csv\.zst$")
FIELDS = ("open", "high", "low", "close", "volume")


def day_path(symbol: str, day: date, side: str) -> str:
    return f"{symbol}/{day.year:04d}/{day.month - 1:02d}/{day.day:02d}_{side}.csv.zst"


def parse_path(path: str) -> tuple[str, date, str] | None:
    """(symbol, date, side); None for what is not a day file or has no such date."""
    if not (m := PATH.search(path)):
        return None
    try:
        return m[1], date(int(m[2]), int(m[3]) + 1, int(m[4])), m[5]
    except ValueError:
        return None


def enumerate_days(spark: SparkSession, root: str, symbol: str, side: str, start_ms: int, end_ms: int) -> list[tuple[date, str]]:
    """(date, path) of the files from the start's date to the end's date, both inclusive, in order."""
    return [(d, p) for d, p, _ in _listed(spark, root, symbol, side, start_ms, end_ms)]


def _listed(spark: SparkSession, root: str, symbol: str, side: str, start_ms: int, end_ms: int) -> list[tuple[date, str, int]]:
    """With the files' sizes."""
    jvm = spark.sparkContext._jvm
    first, last = (datetime.fromtimestamp(ms / 1000, UTC).date() for ms in (start_ms, end_ms))
    months, at = [], first.replace(day=1)
    while at <= last:
        months.append(at)
        at = (at + timedelta(days=32)).replace(day=1)
    out = set()
    for m in months:
        glob = jvm.org.apache.hadoop.fs.Path(f"{root}/{symbol}/{m.year:04d}/{m.month - 1:02d}/*_{side}.csv.zst")
        for f in glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []:
            path = f.getPath().toString()
            if (p := parse_path(path)) and first <= p[1] <= last:
                out.add((p[1], path, f.getLen()))
    return sorted(out)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["symbol", "side", "day", "ts_ms", "open", "high", "low", "close", "tick_volume", "error"]
    for b in batches:
        for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
            symbol, day, side = parse_path(path)
            number = (day - date(1970, 1, 1)).days
            try:
                t = csv.read_csv(pa.CompressedInputStream(pa.BufferReader(content), "zstd"), convert_options=csv.ConvertOptions(column_types={"timestamp": pa.string()} | dict.fromkeys(FIELDS, pa.float64())))
                ms = pc.cast(pc.strptime(pc.utf8_slice_codeunits(t["timestamp"], 0, 19), "%Y-%m-%d %H:%M:%S", "ms"), pa.int64())
                zone = pc.utf8_slice_codeunits(t["timestamp"], 19, 25)
                sign = pc.if_else(pc.equal(pc.utf8_slice_codeunits(zone, 0, 1), "-"), 1, -1)
                off = pc.add(pc.multiply(pc.cast(pc.utf8_slice_codeunits(zone, 1, 3), pa.int64()), 60), pc.cast(pc.utf8_slice_codeunits(zone, 4, 6), pa.int64()))
                ms = pc.add(ms, pc.multiply(pc.multiply(sign, off), 60_000))
                cols = [ms.combine_chunks(), *[t[f].combine_chunks() for f in FIELDS]]
                error = None
            except (pa.ArrowInvalid, OSError, KeyError) as e:
                cols, error = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * 5], f"corrupt_source_file: {str(e)[:200]}"
            n = len(cols[0])
            yield pa.record_batch([pa.array([symbol] * n), pa.array([side] * n), pa.array([number] * n, pa.int64()), *cols, pa.array([error] * n, pa.string())], names)


def read_minutes(spark: SparkSession, root: str, symbol: str, side: str, start_ms: int, end_ms: int) -> tuple[DataFrame, DataFrame]:
    """1-minute bars with start <= ts_ms < end, and (symbol, side, day, error) of the files that cannot be read."""
    found = _listed(spark, root, symbol, side, start_ms, end_ms)
    paths = [p for _, p, size in found if size]
    empty = [(symbol, side, (d - date(1970, 1, 1)).days, "corrupt_source_file: empty") for d, _, size in found if not size]  # Spark gives no row for these
    schema = "symbol string, side string, day long, ts_ms long, open double, high double, low double, close double, tick_volume double, error string"
    if not paths:
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_decode, schema)
    bars = rows.filter(F.col("error").isNull() & (F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms)).drop("day", "error")
    bad = rows.filter("error IS NOT NULL").select("symbol", "side", "day", "error").distinct()
    return bars, bad.unionByName(spark.createDataFrame(empty, bad.schema)) if empty else bad


def fingerprints(spark: SparkSession, root: str, symbol: str, side: str, start_ms: int, end_ms: int) -> DataFrame:
    """symbol, side, day and fingerprint (sha256 of the compressed bytes) of the files that exist."""
    found = enumerate_days(spark, root, symbol, side, start_ms, end_ms)
    if not found:
        return spark.createDataFrame([], "symbol string, side string, day long, fingerprint string")
    f = spark.read.format("binaryFile").load([p for _, p in found])
    part = lambda i: F.regexp_extract("path", PATH.pattern, i)
    day = F.unix_date(F.make_date(part(2).cast("int"), part(3).cast("int") + 1, part(4).cast("int"))).cast("long")
    return f.select(part(1).alias("symbol"), part(5).alias("side"), day.alias("day"), F.sha2("content", 256).alias("fingerprint"))


def day_ms(day: date) -> int:
    return (day - date(1970, 1, 1)).days * DAY


__all__ = ["SIDES", "day_ms", "day_path", "enumerate_days", "fingerprints", "parse_path", "read_minutes"]
