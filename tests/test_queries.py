import pytest

from tests.compare import of_duckdb, of_spark
from tickloom.plans import queries as plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = of_spark(QUERIES[name](spark, tables))
    assert got[0]
    if name in SQL:
        assert got == of_duckdb(SQL[name], tables)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "seas_hour_of_day" in e.queries()


def test_without_the_llm_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tickloom"), tmp_path / "tickloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


@pytest.fixture(scope="module")
def bucket_ends(tables, tmp_path_factory):
    """A folder whose events also have ticks within the last millisecond of an hour, on both sides of its middle."""
    import duckdb

    d = str(tmp_path_factory.mktemp("bucket_ends"))
    late = " UNION ALL ".join(f"SELECT event_id * 10 + {k}, date_trunc('hour', ts) + INTERVAL {3_600_000_000 - us} MICROSECONDS, user_id, event_type, value * {k} + 1, props FROM e WHERE event_id % 7 = {k}" for k, us in ((2, 400), (3, 500), (4, 501)))
    duckdb.sql(f"COPY (WITH e AS (SELECT * FROM '{tables}/events.parquet') SELECT event_id * 10 AS event_id, ts, user_id, event_type, value, props FROM e UNION ALL {late}) TO '{d}/events.parquet' (FORMAT PARQUET)")
    return d


BUCKET_ENDS = [
    "adf_lag0",
    "fdr_benjamini_hochberg",
    "jarque_bera",
    "ljung_box",
    "ljung_box_sq",
    "ou_halflife",
    "outliers",
    "resample_10m",
    "resample_15m",
    "resample_1h",
    "resample_5m",
    "seas_day_of_week",
    "seas_hour_of_day",
    "seas_session",
]


@pytest.mark.parametrize("name", BUCKET_ENDS)
def test_ticks_at_the_end_of_a_bucket(spark, bucket_ends, name):
    import pyarrow.parquet as pq

    assert of_spark(QUERIES[name](spark, bucket_ends)) == of_duckdb(SQL[name], views={"events": pq.read_table(f"{bucket_ends}/events.parquet")})


def test_stream_of_ticks_at_the_end_of_a_bucket(spark, bucket_ends, tmp_path):
    from pyspark.sql import functions as F

    from tickloom.streaming.resample import bars_of_stream

    src = spark.read.parquet(f"{bucket_ends}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.createDataFrame([(None, None, None, "zzz", 1.0, None)], src.schema).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    src.unionByName(end).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = bars_of_stream(stream, "1h", ["event_type"], "ts", "value", "event_id").writeStream.outputMode("append").format("memory").queryName("end_bars").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.event_type, r.ts_ms, r.open, r.close, r.tick_volume) for r in spark.sql("SELECT * FROM end_bars").collect())
    assert got == sorted((r.symbol, r.ts_ms, r.open, r.close, r.tick_volume) for r in plans.event_bars(spark, bucket_ends).collect())


@pytest.fixture(scope="module")
def no_prices(tables, tmp_path_factory):
    """A folder whose events also have ticks without a price, a microsecond before and after each of the others."""
    import duckdb

    d = str(tmp_path_factory.mktemp("no_prices"))
    none = " UNION ALL ".join(f"SELECT event_id * 10 + {k}, ts + to_microseconds({us}), user_id, event_type, NULL, props FROM e" for k, us in ((1, -1), (2, 1)))
    duckdb.sql(f"COPY (WITH e AS (SELECT * FROM '{tables}/events.parquet') SELECT event_id * 10 AS event_id, ts, user_id, event_type, value, props FROM e UNION ALL {none}) TO '{d}/events.parquet' (FORMAT PARQUET)")
    return d


NO_PRICES = [
    "jarque_bera",
    "ljung_box",
    "ljung_box_sq",
    "ou_halflife",
    "outliers",
    "resample_10m",
    "resample_15m",
    "resample_1h",
    "resample_5m",
    "seas_day_of_week",
    "seas_hour_of_day",
]


@pytest.mark.parametrize("name", NO_PRICES)
def test_ticks_without_a_price(spark, no_prices, name):
    import pyarrow.parquet as pq

    assert of_spark(QUERIES[name](spark, no_prices)) == of_duckdb(SQL[name], views={"events": pq.read_table(f"{no_prices}/events.parquet")})


def test_stream_of_ticks_without_a_price(spark, no_prices, tmp_path):
    from pyspark.sql import functions as F

    from tickloom.streaming.resample import bars_of_stream

    src = spark.read.parquet(f"{no_prices}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.createDataFrame([(None, None, None, "zzz", 1.0, None)], src.schema).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    src.unionByName(end).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = bars_of_stream(stream, "1h", ["event_type"], "ts", "value", "event_id").writeStream.outputMode("append").format("memory").queryName("no_prices").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.event_type, r.ts_ms, r.open, r.close, r.tick_volume) for r in spark.sql("SELECT * FROM no_prices").collect())
    assert got and None not in {x for r in got for x in r}
    assert got == sorted((r.symbol, r.ts_ms, r.open, r.close, r.tick_volume) for r in plans.event_bars(spark, no_prices).collect())
