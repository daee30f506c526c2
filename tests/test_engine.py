import io
import json
import os
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom import cli
from tickloom.functions.series import indexed
from tickloom.model import DAY, MINUTE, Invalid, ScanRequest
from tickloom.operators import cross, hygiene, kernels
from tickloom.plans import engine
from tickloom.plans.registry import SCANS
from tickloom.sources import dayfiles
from tickloom.sources.cache import BarCache, stale_days
from tickloom.sources.findings import envelopes, write_lines

MON = 1_704_067_200_000
TUE, THU = MON + DAY, MON + 3 * DAY


def day_file(root, symbol, day, side="bid", skip=(), seed=0):
    path = os.path.join(root, dayfiles.day_path(symbol, day, side))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    close = 1 + np.random.default_rng([seed, day.toordinal()]).random(1440)
    lines = ["timestamp,open,high,low,close,volume"]
    for m in range(1440):
        if m not in skip:
            lines.append(f"{day} {m // 60:02d}:{m % 60:02d}:00+00:00,{close[m]:.6f},{close[m] + 1e-5:.6f},{close[m] - 1e-5:.6f},{close[m]:.6f},{m + 1}")
    with pa.CompressedOutputStream(path, "zstd") as f:
        f.write(("\n".join(lines) + "\n").encode())
    return path


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = str(tmp_path_factory.mktemp("days"))
    for k in (2, 3):
        day_file(r, "EURUSD", date(2024, 1, k), skip=range(60, 75) if k == 3 else ())
        day_file(r, "GBPUSD", date(2024, 1, k), seed=1)
    return r


@pytest.fixture(scope="module")
def minutes(spark, root):
    return cli.minutes(spark, root, [ScanRequest("x", ("EURUSD:bid", "GBPUSD:bid"), "15m", (TUE, THU))]).persist()


def test_paths():
    assert dayfiles.parse_path("x/EURUSD/2024/00/31_bid.csv.zst") == ("EURUSD", date(2024, 1, 31), "bid")
    for bad in ("x/EURUSD/2024/12/01_bid.csv.zst", "x/EURUSD/2024/01/31_bid.csv.zst", "x/EURUSD/2024/00/01_mid.csv.zst"):
        assert dayfiles.parse_path(bad) is None
    assert dayfiles.day_path("A", date(2024, 12, 5), "ask") == "A/2024/11/05_ask.csv.zst"


def test_day_files(spark, root, tmp_path):
    bars, bad = dayfiles.read_minutes(spark, root, "EURUSD", "bid", TUE, TUE + DAY)
    assert bars.count() == 1440 and bad.count() == 0
    assert [d for d, _ in dayfiles.enumerate_days(spark, root, "EURUSD", "bid", TUE, TUE + DAY)] == [date(2024, 1, 2), date(2024, 1, 3)]
    assert dayfiles.enumerate_days(spark, root, "NONE", "bid", TUE, THU) == []
    other = str(tmp_path)
    day_file(other, "A", date(2024, 1, 2))
    path = day_file(other, "A", date(2024, 1, 3))
    with open(path, "wb") as f:
        f.write(b"not zstd")
    open(day_file(other, "A", date(2024, 1, 4)), "wb").close()
    bars, bad = dayfiles.read_minutes(spark, other, "A", "bid", TUE, THU + DAY)
    assert bars.count() == 1440 and sorted(r.day - MON // DAY for r in bad.collect()) == [2, 3]


def test_cache_rebuilds_only_what_changed(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "cache")
    for k in (2, 3):
        day_file(src, "A", date(2024, 1, k))
    read = lambda: dayfiles.read_minutes(spark, src, "A", "bid", TUE, THU)[0]
    prints = lambda: dayfiles.fingerprints(spark, src, "A", "bid", TUE, THU - 1)
    cache = BarCache(spark, store)
    first = cache.get_or_build(read(), prints(), "1h", TUE, THU).collect()
    assert len(first) == 48
    assert cache.get_or_build(read().limit(0), prints(), "1h", TUE, TUE + DAY).count() == 24  # a hit, cut to the range
    old = prints().collect()
    day_file(src, "A", date(2024, 1, 3), seed=9)
    before = spark.createDataFrame(old, prints().schema)
    assert [r.day for r in stale_days(prints(), before).collect()] == [MON // DAY + 2]
    again = cache.get_or_build(read(), prints(), "1h", TUE, THU)
    a, b = ({r.ts_ms: r.close for r in x} for x in ([r for r in first if r.ts_ms < TUE + DAY], again.collect()))
    assert all(b[t] == c for t, c in a.items()) and len(b) == 48


PARAMS = {
    "stats.vol.rolling": {"window": 10}, "cross.corr.pearson_rolling": {"window": 20}, "cross.corr.spearman_rolling": {"window": 20}, "cross.ols.rolling": {"window": 20}, "cross.cointegration.rolling": {"window": 40, "step": 20},
    "seas.test.anova_kruskal": {"buckets_via": "session"}, "seas.event.pre_post_window": {"event_timestamps": [TUE + 3 * 3_600_000]},
}


#: One scan of each kind of headline and input; the others' rows are tested as queries.
RUN = ("cross.cointegration.rolling@1", "cross.lead_lag.ccf@1", "seas.event.pre_post_window@1", "seas.gap.overnight@1", "seas.test.anova_kruskal@1", "stats.autocorr.ljung_box_sq@1", "stats.returns.profile@1", "stats.vol.rolling@1")


@pytest.mark.parametrize("name", RUN)
def test_scan_runs(minutes, name):
    scan = SCANS[name]
    who = ("EURUSD:bid", "GBPUSD:bid")[: scan.arity]
    got = engine.run(minutes, ScanRequest(name, who, "15m", (TUE, THU), params=PARAMS.get(scan.id, {}))).collect()
    assert all(r.kind == "result" and r.scan == name for r in got)
    if scan.id not in ("seas.gap.overnight",):
        assert got and (name != "stats.returns.profile@1" or len(got) == 2)


def test_strict_policy_and_preflight(minutes):
    strict = ScanRequest("stats.summary.welford@1", ("EURUSD:bid",), "15m", (TUE, THU), "strict")
    assert [r.kind for r in engine.run(minutes, strict).collect()] == ["gap_aborted"]
    ok = ScanRequest("stats.summary.welford@1", ("GBPUSD:bid",), "15m", (TUE, THU), "strict")
    assert [r.kind for r in engine.run(minutes, ok).collect()] == ["result"]
    for bad, code in (
        (ScanRequest("none@1", ("A:bid",), "15m", (TUE, THU)), "unknown_scan"), (ScanRequest("stats.vol.rolling@1", ("A:bid",), "15m", (TUE, THU)), "invalid_parameter"),
        (ScanRequest("cross.lead_lag.ccf@1", ("A:bid",), "15m", (TUE, THU)), "wrong_instrument_arity"), (ScanRequest("stats.returns.profile@1", ("A:bid",), "15m", (TUE, THU), bootstrap="stationary"), "hygiene_not_supported"),
        (ScanRequest("stats.summary.welford@1", ("A:bid",), "15m", (TUE + MINUTE, THU)), "invalid_parameter"),
    ):
        with pytest.raises(Invalid) as e:
            engine.preflight(bad)
        assert e.value.code == code


@pytest.mark.parametrize("name", ["cross.corr.pearson_rolling@1", "cross.corr.spearman_rolling@1", "cross.ols.rolling@1", "cross.lead_lag.ccf@1", "cross.cointegration.engle_granger@1"])
def test_pairs_are_resampled(minutes, name):
    scan = SCANS[name]
    r = ScanRequest(name, ("EURUSD:bid", "GBPUSD:bid"), "15m", (TUE, THU), params=PARAMS.get(scan.id, {}), bootstrap="stationary", bootstrap_n=20, null="circular_shift", null_n=19)
    got = engine.run(minutes, r).collect()
    assert got and all(x.ci_low <= x.ci_high and 0 < x.p_value <= 1 for x in got)
    _, params, who = engine.preflight(r)
    data, _, keys = engine.prepared(minutes, r, who, True)
    cols, stat, _ = hygiene.statistic(scan.id, params)
    s = (cross.pair_returns if cols == ("ra", "rb") else indexed)(data, [*keys, "segment"]).orderBy("i").toPandas()
    for x in got:
        own = s[s.segment == x.segment]
        assert stat(*(own[c].to_numpy(float) for c in cols)) == pytest.approx(x.value, abs=1e-6)


def test_statistics_follow_the_parameters():
    x = np.cumsum(np.random.default_rng(3).normal(0, 1, 200)) + 500
    r = np.diff(np.log(x))
    of = lambda scan, given: hygiene.statistic(scan, SCANS[f"{scan}@1"].resolve(given))[1]
    assert of("stats.variance_ratio.lo_mackinlay", {"k_values": [2, 4]})(r) == pytest.approx(hygiene._vr(r, 4))
    assert of("stats.stationarity.adf", {"regression": "ct"})(x) == kernels.adf(x, None, "ct", "AIC")[0]["tau"]
    assert of("stats.heteroskedasticity.arch_lm", {"lag": 3})(r) == kernels.arch_lm(r, 3)[0]["lm"]
    assert of("stats.stationarity.kpss", {"nlags": 1})(x) != of("stats.stationarity.kpss", {})(x) != of("stats.stationarity.kpss", {"regression": "ct"})(x)
    assert of("stats.vol.rolling", {"window": 10})(r) == pytest.approx(r[-10:].std(ddof=1))


MANIFEST = """
[sweep]
seed = 7
[hygiene]
bootstrap = "stationary"
bootstrap_n = 60
[fdr]
family = "scan_id"
[[jobs]]
scan = "stats.autocorr.ljung_box@1"
instruments = ["EURUSD:bid", "GBPUSD:bid"]
timeframes = ["15m", "1h"]
windows = ["2024-01-02:2024-01-04"]
[jobs.params]
most = [4, 6]
"""


def test_sweep(minutes):
    sweep = engine.parse_sweep(MANIFEST)
    assert len(sweep.jobs) == 8 and {j.params["most"] for j in sweep.jobs} == {4, 6}
    assert engine.parse_sweep(MANIFEST, seed=9).jobs[0].seed == 9
    with pytest.raises(Invalid):
        engine.parse_sweep(MANIFEST.replace("seed = 7", "max_jobs = 3"))
    small = engine.Sweep(sweep.jobs[:2], "all")
    a, b = (sorted(engine.run_sweep(minutes, small).collect()) for _ in range(2))
    assert a == b and all(r.fdr_q is not None and r.fdr_q >= r.p_value - 1e-12 for r in a) and all(r.ci_low <= r.ci_high for r in a)
    assert engine.summary(engine.run_sweep(minutes, small)).first().n_result == len(a)
    out = io.StringIO()
    assert write_lines(envelopes(engine.run_sweep(minutes, small), {}), out) == 0
    kinds = [json.loads(x)["kind"] for x in out.getvalue().splitlines()]
    assert kinds[0] == "run_start" and kinds[-1] == "run_end" and kinds.count("result") == len(a)


def test_command_line(spark, root, capsys, tmp_path):
    assert cli.main(["scans"]) == 0 and len(capsys.readouterr().out.splitlines()) == 28
    assert cli.main(["--root", root, "scan", "none@1", "--instrument", "A:bid", "--timeframe", "1h", "--window", "2024-01-02:2024-01-03"]) == 1
    assert json.loads(capsys.readouterr().err)["code"] == "unknown_scan"
    out = str(tmp_path / "out.jsonl")
    assert cli.main(["--root", root, "--output", out, "scan", "seas.bucket.hour_of_day@1", "--instrument", "EURUSD:bid", "--timeframe", "15m", "--window", "2024-01-02:2024-01-03"]) == 0
    with open(out) as f:
        assert [json.loads(x)["kind"] for x in f] == ["run_start", "result", "sweep_summary", "run_end"]
    assert cli.main(["--root", root, "--output", out, "scan", "seas.bucket.hour_of_day@1", "--instrument", "EURUSD:bid", "--timeframe", "15m", "--window", "2024-01-02:2024-01-03", "--dry-run"]) == 0


def test_stream_gives_the_batch_bars(spark, tables, tmp_path):
    from tickloom.plans.queries import event_bars
    from tickloom.streaming.resample import bars_of_stream

    src = spark.read.parquet(f"{tables}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.createDataFrame([(None, None, None, "zzz", 1.0, None)], src.schema).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = bars_of_stream(stream, "1h", ["event_type"], "ts", "value", "event_id").writeStream.outputMode("append").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.event_type, r.ts_ms, r.open, r.close, r.tick_volume) for r in spark.sql("SELECT * FROM bars_out").collect())
    want = sorted((r.symbol, r.ts_ms, r.open, r.close, r.tick_volume) for r in event_bars(spark, tables).collect())
    assert got == want


def test_parameters_have_their_own_names_and_bad_series_give_scan_errors(spark):
    text = '[sweep]\nseed = 0xDEADBEEF\n[[jobs]]\nscan = "stats.autocorr.ljung_box@1"\ninstruments = ["EURUSD:bid", "GBPUSD:bid"]\ntimeframes = ["15m"]\nwindows = ["2024-01-15:2024-01-29"]\nparams = { lags = 5 }\n[fdr]\nfamily = "scan_id"\nalpha = 0.05\n'
    sweep = engine.parse_sweep(text)
    assert [j.params for j in sweep.jobs] == [{"lags": 5}] * 2 and len(engine.together(sweep.jobs)) == 1
    assert SCANS["stats.outliers.z_and_mad@1"].params == {"z_threshold": 3.0, "modified_z_threshold": 3.5, "series": "log_returns"}
    lo = sweep.jobs[0].window[0]
    rows = [("EURUSD", "bid", lo + i * 60_000, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(2880)]
    bars = spark.createDataFrame(rows, "symbol string, side string, ts_ms long, open double, high double, low double, close double, tick_volume double")
    jobs = engine.parse_sweep(text.replace("ljung_box", "__").replace("stats.autocorr.__", "stats.normality.jarque_bera").replace("params = { lags = 5 }\n", "")).jobs
    got = {r.instruments: r for r in engine.run_sweep(bars, engine.Sweep(jobs)).collect()}
    assert {k: (r.kind, r.error.split(":")[0]) for k, r in got.items()} == {"EURUSD:bid": ("scan_error", "compute_error"), "GBPUSD:bid": ("scan_error", "coverage_gap")}
