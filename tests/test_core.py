import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import dist
from tickloom.functions.calendar import is_open
from tickloom.functions.series import align_down, align_up, hour_of, weekday_of
from tickloom.model import DAY, HOUR, MINUTE, Invalid, ScanRequest, check_aligned, instrument, param_hash, parse_params, window
from tickloom.operators import anom, bars, cross, gaps, hygiene, kernels, seas

MON = 1_704_067_200_000  # Monday 2024-01-01
KEYS = ["symbol", "side"]


def make(spark, closes, step=15 * MINUTE, start=MON + DAY, symbol="AAA", times=None):
    rows = [(symbol, "bid", int(times[i] if times else start + i * step), float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, side string, ts_ms long, open double, high double, low double, close double, tick_volume double")


def walk(n, seed=1, sd=0.01):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sd, n)))


def test_instruments_windows_and_params():
    assert instrument("EURUSD:bid") == ("EURUSD", "bid")
    for bad in ("EURUSD", ":bid", "EURUSD:mid"):
        with pytest.raises(Invalid):
            instrument(bad)
    assert window("2024-01-01:2024-01-02") == (MON, MON + DAY)
    assert window("2024-01-01T01:00:00Z:2024-01-02") == (MON + HOUR, MON + DAY)
    for bad in ("2024-01-02:2024-01-01", "2024-01-01", "2024-01-01T00:00:00:2024-01-02"):
        with pytest.raises(Invalid):
            window(bad)
    assert parse_params(["a=1", "b=x", "c=[1,2]"]) == {"a": 1, "b": "x", "c": [1, 2]}
    with pytest.raises(Invalid):
        parse_params(["a=1", "a=2"])
    with pytest.raises(Invalid):
        check_aligned(MON + MINUTE, "5m")
    assert param_hash({"a": 1, "b": 2}) == param_hash({"b": 2, "a": 1})
    a = ScanRequest("s@1", ("A:bid",), "1h", (0, 1))
    assert a.job_seed() == ScanRequest("s@1", ("A:bid",), "1h", (0, 1)).job_seed() != ScanRequest("s@1", ("B:bid",), "1h", (0, 1)).job_seed()


def test_distributions_have_their_closed_forms():
    for x in (0.1, 1.0, 5.0, 40.0):
        assert dist.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert dist.chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert dist.t_two_sided(x, 1) == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-11)
        assert dist.f_sf(x, 2, 10) == pytest.approx((1 + x / 5) ** -5, rel=1e-11)
    assert float(dist.normal_sf(1.959963984540054)) == pytest.approx(0.025, rel=1e-12)
    assert math.isnan(dist.chi2_sf(math.nan, 2))


@pytest.mark.parametrize(("ms", "open_now"), [
    (MON + DAY, True), (MON, False), (MON + 4 * DAY + 22 * HOUR - MINUTE, True), (MON + 4 * DAY + 22 * HOUR, False), (MON + 5 * DAY, False),
    (MON + 6 * DAY + 22 * HOUR - MINUTE, False), (MON + 6 * DAY + 22 * HOUR, True), (1_703_462_400_000 + 5 * HOUR, False),
])
def test_calendar(spark, ms, open_now):
    assert spark.range(1).select(is_open(F.lit(ms)).alias("x")).first().x is open_now


def test_time_arithmetic(spark):
    x = spark.createDataFrame([(MON + 6 * DAY + 23 * HOUR + 7 * MINUTE,), (-1,)], "ms long")
    got = x.select(hour_of(F.col("ms")), weekday_of(F.col("ms")), align_down(F.col("ms"), 5 * MINUTE), align_up(F.col("ms"), 5 * MINUTE)).collect()
    assert tuple(got[0]) == (23, 6, MON + 6 * DAY + 23 * HOUR + 5 * MINUTE, MON + 6 * DAY + 23 * HOUR + 10 * MINUTE)
    assert tuple(got[1]) == (23, 2, -5 * MINUTE, 0)


def test_resample(spark):
    b = make(spark, [1, 5, 2, 3, 9], times=[MON, MON + MINUTE, MON + 4 * MINUTE, MON + 5 * MINUTE, MON + 20 * MINUTE])
    got = bars.resample(b, "5m", KEYS).orderBy("ts_ms").collect()
    assert [(r.ts_ms - MON, r.open, r.high, r.low, r.close, r.tick_volume) for r in got] == [(0, 1, 5, 1, 2, 3), (5 * MINUTE, 3, 3, 3, 3, 1), (20 * MINUTE, 9, 9, 9, 9, 1)]
    assert bars.within(b, MON, MON + 5 * MINUTE).count() == 3
    assert bars.up_to(b, MON + 5 * MINUTE).count() == 4


def test_future_bars_do_not_change_past_windows(spark):
    x = walk(120)
    y = np.concatenate([x[:80], x[80:][::-1] * 2])
    a, b = (anom.vol_rolling(make(spark, c), KEYS, 10).filter("i < 78").orderBy("i").collect() for c in (x, y))
    assert a == b and len(a) > 50


def test_summary_and_ljung_box_against_numpy(spark):
    x = walk(300)
    r = np.diff(np.log(x))
    got = anom.summary(make(spark, x), KEYS).first()
    assert got["mean"] == pytest.approx(r.mean()) and got["std"] == pytest.approx(r.std(ddof=1))
    skew, kurt = hygiene._moments(r)
    assert got["skew"] == pytest.approx(skew) and got["excess_kurtosis"] == pytest.approx(kurt)
    q = anom.ljung_box(make(spark, x), KEYS).orderBy("lag").collect()
    assert len(q) == 10 and q[-1]["q"] == pytest.approx(hygiene._ljung_box(r)) and q[-1]["p_value"] == pytest.approx(dist.chi2_sf(q[-1]["q"], 10))


def test_constant_and_single_bars_do_not_fail(spark):
    flat, one = make(spark, [5.0] * 60), make(spark, [5.0])
    for b in (flat, one):
        for scan in (anom.returns_profile, anom.summary, anom.ljung_box, anom.jarque_bera, anom.outliers, anom.drawdown, anom.kpss, anom.variance_ratio, anom.ou_halflife, anom.tsmom, anom.adf, anom.arch_lm, anom.cusum_break):
            scan(b, KEYS).collect()
    assert anom.jarque_bera(flat, KEYS).count() == 0
    assert {r.acf for r in anom.ljung_box(flat, KEYS).collect()} == {0.0}


def test_kpss_and_variance_ratio_against_numpy(spark):
    x = walk(200)
    assert anom.kpss(make(spark, x), KEYS).first()["eta"] == pytest.approx(hygiene._kpss(x))
    vr = {r.k: r.vr for r in anom.variance_ratio(make(spark, x), KEYS).collect()}
    assert vr[16] == pytest.approx(hygiene._vr(np.diff(np.log(x))))


def test_drawdown_by_hand(spark):
    got = anom.drawdown_episodes(make(spark, [10, 8, 9, 10, 7, 7, 6]), KEYS, "close").orderBy("peak_i").collect()
    assert [(r.peak_i, r.trough_i, r.depth, r.recovered_ms is None) for r in got] == [(0, 1, -2.0, False), (3, 6, -4.0, True)]
    d = anom.drawdown(make(spark, [10, 8, 9, 10, 7, 7, 6]), KEYS, "close").first()
    assert (d.max_dd, d.n, d.dd_p50) == (-4.0, 1, -2.0)


def test_cusum_finds_a_shift():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 100), rng.normal(4, 1, 100)])
    found = kernels.cusum_breaks(x, np.arange(200), "mean")
    assert found and abs(found[0]["break_index"] - 99) <= 2 and found[0]["post_mean"] > 3
    assert kernels.cusum_breaks(np.zeros(100), np.arange(100)) == []


def test_adf_prefers_stationary_series():
    rng = np.random.default_rng(4)
    noise, path = rng.normal(0, 1, 400), np.cumsum(rng.normal(0, 1, 400))
    assert kernels.adf(noise)[0]["p_value"] <= 0.01 < kernels.adf(path)[0]["p_value"]
    for reg in kernels.ADF_CRITICAL:
        assert kernels.adf(noise, 2, reg, "BIC")


def test_overnight_gaps_by_hand(spark):
    t = [MON + DAY, MON + DAY + 15 * MINUTE, MON + DAY + 120 * MINUTE, MON + DAY + 135 * MINUTE, MON + DAY + 150 * MINUTE]
    b = make(spark, [100, 100, 101, 100.5, 99.9], times=t)
    got = seas.overnight_gaps(b, KEYS, 15 * MINUTE).collect()
    assert [(r.direction, round(r["size"], 6), r.bucket, r.bars_to_fill) for r in got] == [("up", 0.01, 3, 3)]
    assert seas.overnight_gaps(b, KEYS, 15 * MINUTE, lookahead=2).first().bars_to_fill is None


def test_sessions_wrap_midnight():
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    got = s.range(24).select("id", seas.in_session(F.col("id"), 22, 7).alias("x")).filter("x").collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4, 5, 6, 22, 23]


def test_events_out_of_range_are_left_out(spark):
    b = make(spark, walk(40))
    first = MON + DAY
    events = spark.createDataFrame([(first - DAY,), (first + 20 * 15 * MINUTE,), (first + 100 * DAY,)], "event_ms long")
    got = seas.event_window(b, KEYS, events).collect()
    assert [r.i for r in got] == [19]


def test_gaps(spark):
    full = [MON + DAY + k * MINUTE for k in range(1440) if k not in (3, 10, 11, 12, 13, 14, 15, 700)]
    b = make(spark, [1.0] * len(full), times=full)
    g = gaps.detect(b, KEYS, MON + DAY, MON + 3 * DAY)
    assert sorted((r.reason, r.start_ms) for r in g.filter("reason < 2").collect()) == [(0, MON + 2 * DAY)]
    assert g.filter("reason = 2").count() == 8
    e = gaps.effective(g, KEYS, "5m").orderBy("start_ms").collect()
    assert [(r.start_ms - MON - DAY, r.end_ms - r.start_ms) for r in e] == [(10 * MINUTE, 5 * MINUTE), (DAY, DAY)]
    who = b.select(*KEYS).distinct()
    seg = gaps.segments(gaps.effective(g, KEYS, "5m"), KEYS, who, MON + DAY, MON + 3 * DAY, "5m")
    got = seg.orderBy("segment").collect()
    assert [(r.start_ms - MON - DAY, r.end_ms - MON - DAY) for r in got] == [(0, 10 * MINUTE), (15 * MINUTE, DAY)]
    inside = gaps.segmented(bars.resample(b, "5m", KEYS), KEYS, seg)
    assert inside.filter("segment = 1").count() == 2 and inside.count() == 287
    assert gaps.aborted(g, KEYS, MON + DAY, MON + 2 * DAY).first().n_gaps == 8
    bad = spark.createDataFrame([("AAA", "bid", (MON + DAY) // DAY)], "symbol string, side string, day long")
    assert [(r.reason, r.start_ms) for r in gaps.detect(b, KEYS, MON + DAY, MON + 2 * DAY, bad).collect()] == [(1, MON + DAY)]


def test_merge_takes_the_lowest_reason_and_touching_spans(spark):
    g = spark.createDataFrame([("A", 0, 5, 2), ("A", 5, 9, 1), ("A", 12, 13, 2), ("A", 1, 2, 2)], "symbol string, start_ms long, end_ms long, reason int")
    assert sorted(tuple(r) for r in gaps.merged(g, ["symbol"]).collect()) == [("A", 0, 9, 1), ("A", 12, 13, 2)]


def test_cointegration_and_lead_lag(spark):
    b = np.exp(np.cumsum(np.random.default_rng(5).normal(0, 0.01, 400)))
    a = 2 * b + np.random.default_rng(6).normal(0, 0.005, 400)
    pairs = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "pair string, ts_ms long, a double, b double")
    e = cross.engle_granger(pairs, ["pair"]).first()
    assert e.hedge_ratio == pytest.approx(2, abs=0.05) and e.adf_p <= 0.01 and e.ou_half_life < 2
    assert cross.cointegration_rolling(pairs, ["pair"], 100, 50).count() == 7
    late = spark.createDataFrame([("p", i, float(b[i + 3]), float(b[i])) for i in range(390)], "pair string, ts_ms long, a double, b double")
    assert cross.lead_lag(late, ["pair"], 5).filter("best").first().lag == 3


def test_spearman_has_ties(spark):
    rows = [("p", i, float(x), float(y)) for i, (x, y) in enumerate(zip([1, 2, 4, 8, 8, 8, 16, 1], [1, 3, 9, 9, 27, 27, 27, 2], strict=True))]
    got = cross.spearman_rolling(spark.createDataFrame(rows, "pair string, ts_ms long, a double, b double"), ["pair"], 5).collect()
    assert all(r.rho is None or -1 <= round(r.rho, 9) <= 1 for r in got) and len(got) == 3


def test_fdr_by_hand(spark):
    rows = [("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", None), ("f", float("nan")), ("g", 0.5)]
    got = hygiene.fdr(spark.createDataFrame(rows, "family string, p_value double")).collect()
    q = sorted(round(r.fdr_q, 6) for r in got if r.fdr_q is not None)
    assert q == [0.03, 0.04, 0.04, 0.5] and sum(r.fdr_q is None for r in got) == 2


def test_resampling(spark):
    x = np.random.default_rng(7).normal(0.5, 1, 200)
    s = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "symbol string, i long, x double")
    mean = lambda v: float(v.mean())
    for method in ("stationary", "block"):
        a, b = (hygiene.bootstrap_ci(s, ["symbol"], mean, 300, method, seed=3).first() for _ in range(2))
        assert a == b and a.lo < x.mean() < a.hi
    for method in ("circular_shift", "phase_scramble"):
        assert hygiene.null_p(s, ["symbol"], hygiene._ljung_box, 1, 99, method, seed=3).first().p_value > 0.001
    y = hygiene.phase_scramble(np.random.default_rng(1), x)
    assert np.allclose(np.sort(x), np.sort(y)) and not np.allclose(x, y)
    assert math.isnan(hygiene.auto_block(np.ones(50))) and hygiene.auto_block(np.cumsum(x)) > hygiene.auto_block(x)


def test_catalogue_has_28_scans():
    from tickloom.plans.registry import catalogue

    rows = catalogue()
    assert len(rows) == 28
    json.dumps(rows, default=str)


def test_too_many_events_are_refused(spark):
    events = spark.range(100_001).withColumnRenamed("id", "event_ms")
    with pytest.raises(ValueError, match="more than 100000 events"):
        seas.event_window(make(spark, np.arange(1.0, 40.0)), KEYS, events)
