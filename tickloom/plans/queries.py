"""One query for each operator over the tables of a folder, with the same in DuckDB where SQL can say it.

`events` is the tick table (event_type is the symbol, value the price); `orders` gives daily bars over years. Numbers
are rounded on both sides, as the two engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.calendar import is_open
from tickloom.functions.series import r, returns
from tickloom.model import DAY, HOUR, MINUTE, TIMEFRAMES
from tickloom.operators import anom, bars, cross, gaps, hygiene, seas
from tickloom.sources.ticks import bars_of

K = ["symbol"]
JAN1 = 1_704_067_200_000  # 2024-01-01
#: Moments of the event study, fixed.
EVENTS = tuple(JAN1 + d * DAY + 14 * HOUR + 30 * MINUTE for d in (0, 3, 7, 10, 14, 17, 21, 24, 28, 29))


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    return bars_of(spark.read.parquet(f"{sf_dir}/events.parquet"), timeframe, {"event_type": "symbol"}, "ts", "value", "event_id")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("symbol", F.lit("ORD"))
    return bars_of(o, "1d", {"symbol": "symbol"}, "o_orderdate", "o_totalprice", "o_orderkey")


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.aligned(event_bars(spark, sf_dir).withColumn("pair", F.lit("click/view")), ["pair", "symbol"], "symbol", "click", "view")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _bars(table: str, step: int, symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id") -> str:
    ms = f"epoch_ms({ts}::TIMESTAMP)"
    order = f"{{'t': {ts}, 'e': {tie}}}"
    return f"""SELECT {symbol} AS symbol, {ms} - {ms} % {step} AS ts_ms, arg_min({price}::DOUBLE, {order}) AS open, max({price}::DOUBLE) AS high, min({price}::DOUBLE) AS low,
  arg_max({price}::DOUBLE, {order}) AS close, CAST(count({price}) AS DOUBLE) AS tick_volume FROM {table} GROUP BY ALL"""


BARS = _bars("events", HOUR)
ORDERS = _bars("orders", DAY, "'ORD'", "o_orderdate", "o_totalprice", "o_orderkey")
LEVELS = "SELECT symbol, ts_ms, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 AS i FROM b"


def _returns(where: str = "true", x: str = "ln(close / prev)") -> str:
    return f"""SELECT symbol, ts_ms, x, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 AS i FROM (
  SELECT symbol, ts_ms, {x} AS x FROM (SELECT symbol, ts_ms, close, lag(close) OVER w AS prev, lag(ts_ms) OVER w AS prev_ms FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))
  WHERE prev IS NOT NULL AND {where})"""


def _with(body: str, base: str = BARS, s: str | None = None) -> str:
    return f"WITH b AS ({base}), s AS ({s or _returns()}) {body}"


def rr(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def _n(*names: str) -> str:
    return ", ".join(rr(n, n) for n in names)


PAIR = f"""b AS ({BARS}), p AS (SELECT 'click/view' AS pair, y.ts_ms, y.close AS a, x.close AS b, row_number() OVER (ORDER BY y.ts_ms) - 1 AS i FROM b y JOIN b x USING (ts_ms) WHERE y.symbol = 'click' AND x.symbol = 'view'),
q AS (SELECT pair, ts_ms, ra, rb, row_number() OVER (ORDER BY ts_ms) - 1 AS i FROM (SELECT pair, ts_ms, ln(a / lag(a) OVER (ORDER BY ts_ms)) AS ra, ln(b / lag(b) OVER (ORDER BY ts_ms)) AS rb FROM p) WHERE ra IS NOT NULL)"""


def _buckets(bucket: str, buckets: str, base: str = BARS, join: str = "", extra: str = "") -> str:
    return f"""WITH b AS ({base}), s AS ({_returns()}){extra}, k AS (SELECT s.symbol, {bucket} AS bucket, s.x FROM s {join}),
g AS (SELECT symbol, bucket, count(*) AS c, avg(x) AS m, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM k WHERE bucket IS NOT NULL GROUP BY ALL)
SELECT d.symbol, d.bucket, coalesce(g.c, 0) AS count, CASE WHEN g.c >= 5 THEN round(g.m, 6) + 0.0 END AS mean, CASE WHEN g.c >= 5 THEN round(g.sd, 6) + 0.0 END AS std,
  CASE WHEN g.c >= 5 AND g.sd > 0 THEN round(g.m / (g.sd / sqrt(g.c)), 6) + 0.0 END AS t_stat, CASE WHEN g.c >= 5 THEN round(g.q, 6) + 0.0 END AS iqr
FROM (SELECT symbol, unnest({buckets}) AS bucket FROM (SELECT DISTINCT symbol FROM s)) d LEFT JOIN g USING (symbol, bucket)"""


HOUR_SQL, DAY_SQL = f"CAST(s.ts_ms // {HOUR} % 24 AS INT)", f"CAST((s.ts_ms // {DAY} + 3) % 7 AS INT)"
OPEN_NOON = "NOT ((month(d) = 12 AND day(d) = 25) OR (month(d) = 1 AND day(d) = 1)) AND isodow(d) <= 5"
EDGES = f""", td AS (SELECT d, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS up, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d DESC) AS down FROM (
  SELECT unnest(generate_series(date_trunc('month', to_timestamp(min(ts_ms) / 1000)::DATE), last_day(to_timestamp(max(ts_ms) / 1000)::DATE), INTERVAL 1 DAY))::DATE AS d FROM s) WHERE {OPEN_NOON}),
e AS (SELECT datediff('day', DATE '1970-01-01', d) AS day, CASE WHEN down <= 3 THEN 'EOM-' || down WHEN up <= 3 THEN 'SOM-' || up END AS bucket FROM td)"""
IS_OPEN = f"""NOT ((month(d) = 12 AND day(d) = 25) OR (month(d) = 1 AND day(d) = 1)) AND (isodow(d) <= 4 OR (isodow(d) = 5 AND ms % {DAY} < {22 * HOUR}) OR (isodow(d) = 7 AND ms % {DAY} >= {22 * HOUR}))"""


def _lj(squared: bool) -> str:
    x = "x * x" if squared else "x"
    return _with(f"""SELECT symbol, n, lag, {rr("acf", "acf")}, round(n * (n + 2.0) * sum(acf * acf / (n - lag)) OVER (PARTITION BY symbol ORDER BY lag), 6) + 0.0 AS q FROM (
  SELECT c.symbol, c.n, CAST(k.lag AS INT) AS lag, sum(c.c * d.c) / any_value(c.s0) AS acf FROM c JOIN c d ON c.symbol = d.symbol JOIN (SELECT unnest(range(1, 11)) AS lag) k ON d.i = c.i - k.lag
  WHERE k.lag <= least(10, c.n // 5) GROUP BY c.symbol, c.n, k.lag)""", s=_returns()).replace(" SELECT symbol, n, lag", f""", c AS (SELECT symbol, i, x - avg(x) OVER w AS c, count(*) OVER w AS n, var_pop(x) OVER w * count(*) OVER w AS s0 FROM (SELECT symbol, i, {x} AS x FROM s) WINDOW w AS (PARTITION BY symbol)) SELECT symbol, n, lag""", 1)  # fmt: skip


def _vr_sql() -> str:
    parts = []
    for k in (2, 4, 8, 16):
        var = " + ".join(f"{(2.0 * (k - j) / k) ** 2!r}::DOUBLE * d{j}" for j in range(1, k))
        parts.append(f"""SELECT symbol, n, {k} AS k, (q{k} / ({k} * (n - {k} + 1) * (1 - {k}.0 / n))) / (su / (n - 1)) AS vr, ({var}) / (su * su) AS v FROM g WHERE n >= {2 * k}""")
    frames = ", ".join(f"CASE WHEN i >= {k - 1} THEN sum(c) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS s{k}" for k in (2, 4, 8, 16))
    lag = ", ".join(f"lag(u, {j}) OVER (PARTITION BY symbol ORDER BY i) AS u{j}" for j in range(1, 16))
    sums = ", ".join([f"sum(s{k} * s{k}) AS q{k}" for k in (2, 4, 8, 16)] + [f"coalesce(sum(u * u{j}), 0) AS d{j}" for j in range(1, 16)])
    return f"""WITH b AS ({BARS}), s AS ({_returns()}), c AS (SELECT symbol, i, n, c, c * c AS u FROM (SELECT symbol, i, x - avg(x) OVER w AS c, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY symbol))),
f AS (SELECT symbol, n, u, {frames}, {lag} FROM c), g AS (SELECT symbol, n, sum(u) AS su, {sums} FROM f GROUP BY symbol, n), o AS ({" UNION ALL ".join(parts)})
SELECT symbol, n, k, {rr("vr", "vr")}, {rr("(vr - 1) / sqrt(v)", "z")} FROM o"""


EG = f"""{{head}}, fit AS (SELECT {{k}}, count(*) AS n, regr_slope(a, b) AS beta, regr_intercept(a, b) AS alpha FROM {{p}} GROUP BY {{k}}),
e AS (SELECT {{k}}, i, n, beta, alpha, a - alpha - beta * b AS e FROM {{p}} JOIN fit USING ({{k}})), d AS (SELECT *, lag(e) OVER (PARTITION BY {{k}} ORDER BY i) AS e1 FROM e),
h AS (SELECT {{k}}, n, beta, alpha, stddev_samp(e) AS residual_std, count(e1) AS m, regr_slope(e - e1, e1) AS rho, regr_sxx(e - e1, e1) AS sxx, regr_syy(e - e1, e1) AS syy, regr_sxy(e - e1, e1) AS sxy FROM d GROUP BY ALL),
t AS (SELECT *, rho / sqrt(greatest(syy - rho * sxy, 0) / (m - 2) / sxx) AS tau FROM h),
u AS (SELECT {{k}}, n, beta AS hedge_ratio, alpha, tau AS adf_stat, CASE WHEN rho > -1 AND rho < 0 THEN {-0.6931471805599453!r} / ln(1 + rho) END AS ou_half_life, residual_std,
  CASE WHEN tau <= -3.43 THEN 0.01 * exp(tau + 3.43) WHEN tau <= -2.86 THEN 0.01 + (tau + 3.43) / 0.57 * 0.04 WHEN tau <= -2.57 THEN 0.05 + (tau + 2.86) / 0.29 * 0.05 WHEN tau < 0 THEN 0.1 + (tau + 2.57) / 2.57 * 0.9 ELSE 1.0 END AS adf_p FROM t)"""

TS_VALUES = ", ".join(f"({e}::BIGINT)" for e in EVENTS)
GAP_STEP = HOUR


def _gaps_sql(tail: str) -> str:
    return f"""WITH b AS ({BARS}), o AS (SELECT *, row_number() OVER w - 1 AS i, lead(open) OVER w AS next_open, lead(ts_ms) OVER w AS next_ms FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
g AS (SELECT symbol, i, next_ms AS ts_ms, close, (next_open - close) / close AS size FROM o WHERE next_ms - ts_ms > {int(1.5 * 60)} * 60000 AND abs((next_open - close) / close) > 0),
f AS (SELECT g.symbol, g.i, min(o.i - g.i) AS fill FROM g JOIN o ON o.symbol = g.symbol AND o.i > g.i AND o.i <= g.i + 48 AND (CASE WHEN g.size > 0 THEN o.low <= g.close ELSE o.high >= g.close END) GROUP BY ALL),
x AS (SELECT g.symbol, g.ts_ms, g.size, CASE WHEN g.size > 0 THEN 'up' ELSE 'down' END AS direction, CASE WHEN abs(g.size) < 0.0005 THEN 0 WHEN abs(g.size) < 0.001 THEN 1 WHEN abs(g.size) < 0.002 THEN 2 ELSE 3 END AS bucket, CAST(f.fill AS INT) AS bars_to_fill
  FROM g LEFT JOIN f ON f.symbol = g.symbol AND f.i = g.i) {tail}"""


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one instrument's 1-minute bars."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("symbol", F.lit("ALL"))
    from tickloom.functions.series import align_down, epoch_ms

    b = e.select("symbol", align_down(epoch_ms(F.col("ts")), MINUTE).alias("ts_ms"), F.col("value").alias("p"), F.when(F.col("value").isNotNull(), F.struct("ts", "event_id")).alias("o"))
    return b.groupBy("symbol", "ts_ms").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count("p").cast("double").alias("tick_volume"))


#: The days of all events, from the first to the last.
START, END = "(SELECT lo FROM span)", "(SELECT hi FROM span)"
SPAN = f"span AS (SELECT epoch_ms(min(ts)::TIMESTAMP) // {DAY} * {DAY} AS lo, (epoch_ms(max(ts)::TIMESTAMP) // {DAY} + 1) * {DAY} AS hi FROM events)"
MISSING = f"""{SPAN}, m AS (SELECT ms FROM (SELECT ms, to_timestamp(ms / 1000)::DATE AS d FROM (SELECT unnest(range({START}, {END}, {MINUTE})) AS ms)) WHERE {IS_OPEN}),
h AS (SELECT DISTINCT epoch_ms(ts::TIMESTAMP) // {MINUTE} * {MINUTE} AS ms FROM events),
day AS (SELECT DISTINCT ms // {DAY} AS d FROM m), full_day AS (SELECT d FROM day WHERE d NOT IN (SELECT ms // {DAY} FROM h)),
gap AS (SELECT d * {DAY} AS start_ms, (d + 1) * {DAY} AS end_ms, 0 AS reason FROM full_day UNION ALL
  SELECT ms, ms + {MINUTE}, 2 FROM m WHERE ms // {DAY} NOT IN (SELECT d FROM full_day) AND ms NOT IN (SELECT ms FROM h))"""
RUNS = f"""{MISSING}, i AS (SELECT *, sum(CASE WHEN start_ms <= reach THEN 0 ELSE 1 END) OVER (ORDER BY start_ms, end_ms) AS island FROM (
  SELECT *, max(end_ms) OVER (ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gap WHERE reason = 2)),
run AS (SELECT min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY island),
eff AS (SELECT start_ms, end_ms, reason FROM gap WHERE reason < 2 UNION ALL SELECT * FROM (SELECT -(-start_ms // {5 * MINUTE}) * {5 * MINUTE} AS start_ms, end_ms // {5 * MINUTE} * {5 * MINUTE} AS end_ms, 2 AS reason FROM (SELECT start_ms + {5 * MINUTE} - 1 AS start_ms, end_ms FROM run)) WHERE start_ms < end_ms)""".replace(f"-(-start_ms // {5 * MINUTE}) * {5 * MINUTE} AS start_ms", f"start_ms // {5 * MINUTE} * {5 * MINUTE} AS start_ms")


def _days(spark, sf_dir) -> tuple[int, int]:
    """The window that SPAN names: one row comes to the driver."""
    from tickloom.functions.series import epoch_ms

    ts = epoch_ms(F.col("ts"))
    lo, hi = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(ts), F.max(ts)).first()
    return (JAN1, JAN1) if lo is None else (lo // DAY * DAY, (hi // DAY + 1) * DAY)


def _detected(spark, sf_dir):
    return gaps.detect(minute_bars(spark, sf_dir), K, *_days(spark, sf_dir))


def _effective(spark, sf_dir):
    return gaps.effective(_detected(spark, sf_dir), K, "5m")


def _segments(spark, sf_dir):
    who = minute_bars(spark, sf_dir).select("symbol").distinct()
    return gaps.segments(_effective(spark, sf_dir), K, who, *_days(spark, sf_dir), "5m")


def _pair_gaps(spark, sf_dir):
    b = event_bars(spark, sf_dir, "5m").filter("symbol IN ('click', 'view')")
    minutes = spark.range(*_days(spark, sf_dir), 5 * MINUTE).select(F.col("id").alias("ts_ms")).filter(is_open(F.col("ts_ms")))
    who = b.select("symbol").distinct()
    missing = who.crossJoin(F.broadcast(minutes)).join(b.select("symbol", "ts_ms"), ["symbol", "ts_ms"], "left_anti")
    legs = missing.select(F.lit("click/view").alias("pair"), "symbol", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 5 * MINUTE).alias("end_ms"), F.lit(2).alias("reason"))
    return gaps.of_pair(legs, ["pair", "symbol"], "symbol")


def _fdr(spark, sf_dir):
    j = anom.jarque_bera(event_bars(spark, sf_dir), K).select("symbol", F.lit("stats").alias("family"), "p_value")
    s = seas.bucket_scan(event_bars(spark, sf_dir), K, "hour_of_day").filter("t_stat IS NOT NULL")
    s = s.select(F.concat_ws("/", "symbol", "bucket").alias("symbol"), F.lit("seas").alias("family"), F.exp(-F.abs("t_stat")).alias("p_value"))
    return rounded(hygiene.fdr(j.unionByName(s)))


def _bootstrap(spark, sf_dir):
    return hygiene.bootstrap_ci(returns(event_bars(spark, sf_dir), K), K, lambda x: float(x.mean()), 500, seed=7)


def _null(spark, sf_dir):
    return hygiene.null_p(returns(event_bars(spark, sf_dir), K), K, hygiene.STATISTICS["stats.autocorr.ljung_box"][1], 1, 200, "phase_scramble", seed=7)


def _pair_null(spark, sf_dir):
    import numpy as np

    corr = lambda a, b: float(np.corrcoef(a, b)[0, 1])
    return hygiene.null_p(cross.pair_returns(pair(spark, sf_dir), ["pair"]), ["pair"], corr, 0, 500, "circular_shift", seed=7, cols=("ra", "rb"))


def _cliffs(spark, sf_dir):
    s = returns(event_bars(spark, sf_dir), K).select("symbol", "x", F.when(seas.hour_of(F.col("ts_ms")) < 12, "a").otherwise("b").alias("side"))
    return rounded(hygiene.cliffs_delta(s, K))


def _query(make, round_it: bool = True):
    return lambda spark, sf_dir: rounded(make(spark, sf_dir)) if round_it else make(spark, sf_dir)


def _on_bars(scan, *a, **kw):
    return _query(lambda s, d: scan(event_bars(s, d), K, *a, **kw))


def _on_pair(scan, *a, **kw):
    return _query(lambda s, d: scan(pair(s, d), ["pair"], *a, **kw))


def _entries() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for tf, step in TIMEFRAMES.items():
        out[f"resample_{tf}"] = (_query(lambda s, d, tf=tf: bars.resample(minute_bars(s, d), tf, K)), f"SELECT symbol, ts_ms, {_n('open', 'high', 'low', 'close', 'tick_volume')}, ts_ms + {step} AS ts_close_ms FROM ({_bars('events', step, chr(39) + 'ALL' + chr(39))})")
    ret = "SELECT symbol, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std FROM s GROUP BY symbol HAVING count(*) >= 2"
    same = f"ts_ms // {DAY} {{}} prev_ms // {DAY}"
    for v, s in {"log": _returns(), "simple": _returns(x="(close - prev) / prev"), "intraday": _returns(same.format("=")), "overnight": _returns(same.format("<>"))}.items():
        out[f"returns_profile_{v}"] = (_on_bars(anom.returns_profile, v), _with(ret, s=s))
    out["range_filter"] = (_query(lambda s, d: bars.within(event_bars(s, d), JAN1 + DAY, JAN1 + 2 * DAY)), f"SELECT symbol, ts_ms, {_n('open', 'high', 'low', 'close', 'tick_volume')} FROM ({BARS}) WHERE ts_ms >= {JAN1 + DAY} AND ts_ms < {JAN1 + 2 * DAY}")
    out["look_ahead_safe_prefix"] = (_query(lambda s, d: bars.up_to(event_bars(s, d), JAN1 + 3 * DAY)), f"SELECT symbol, ts_ms, {_n('open', 'high', 'low', 'close', 'tick_volume')} FROM ({BARS}) WHERE ts_ms <= {JAN1 + 3 * DAY}")
    out["calendar_open_hours"] = (
        lambda s, d: event_bars(s, d).select("symbol", "ts_ms", is_open(F.col("ts_ms")).alias("open_now")),
        f"SELECT symbol, ms AS ts_ms, {IS_OPEN} AS open_now FROM (SELECT symbol, ts_ms AS ms, to_timestamp(ts_ms / 1000)::DATE AS d FROM ({BARS}))",
    )
    out["summary_welford"] = (_on_bars(anom.summary), _with(f"SELECT symbol, count(*) AS n, {rr('avg(x)', 'mean')}, {rr('stddev_samp(x)', 'std')}, {rr('skewness(x)', 'skew')}, {rr('kurtosis(x)', 'excess_kurtosis')}, {rr('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 'iqr')}, {rr('min(x)', 'min')}, {rr('max(x)', 'max')}, {rr('avg(x) / stddev_samp(x)', 'cohens_d')} FROM s GROUP BY symbol"))
    w = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    vol = f"v AS (SELECT symbol, i, first_value(ts_ms) {w} AS window_start_ms, stddev_samp(x) {w} AS vol FROM s), f AS (SELECT * FROM v WHERE i >= 19)"
    out["vol_rolling"] = (_on_bars(anom.vol_rolling, 20), _with(f", {vol} SELECT symbol, i, window_start_ms, {rr('vol', 'vol')}, CASE WHEN i >= 38 THEN round(stddev_samp(vol) {w}, 6) + 0.0 END AS vol_of_vol FROM f").replace(") ,", "),", 1))
    out["vol_rolling_headline"] = (_query(lambda s, d: anom.vol_headline(anom.vol_rolling(event_bars(s, d), K, 20), K)), _with(f", {vol} SELECT symbol, count(*) AS n, {rr('arg_max(vol, i)', 'last_vol')}, {rr('arg_max(vol, i) / avg(vol)', 'vol_ratio')} FROM f GROUP BY symbol").replace(") ,", "),", 1))
    out["ljung_box"] = (_on_bars(anom.ljung_box, p_values=False), _lj(False))
    out["ljung_box_sq"] = (_on_bars(anom.ljung_box, squared=True, p_values=False), _lj(True))
    out["ljung_box_p_values"] = (_on_bars(anom.ljung_box), None)
    out["jarque_bera"] = (_on_bars(anom.jarque_bera), _with(f", m AS (SELECT symbol, count(*) AS n, skewness(x) AS skew, kurtosis(x) AS k FROM s GROUP BY symbol HAVING count(*) >= 4), j AS (SELECT *, n / 6.0 * (skew * skew + k * k / 4) AS jb FROM m) SELECT symbol, n, {rr('skew', 'skew')}, {rr('k', 'excess_kurtosis')}, {rr('jb', 'jb')}, {rr('exp(-jb / 2)', 'p_value')}, {rr('jb / n', 'jb_per_n')} FROM j").replace(") ,", "),", 1))
    out["outliers"] = (_on_bars(anom.outliers, z=2.0, modified_z=2.5), _with(f", a AS (SELECT symbol, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd, median(x) AS med FROM s GROUP BY symbol), m AS (SELECT symbol, median(abs(x - med)) AS mad FROM s JOIN a USING (symbol) GROUP BY symbol), z AS (SELECT symbol, i, ts_ms, n, med, mad, (x - mean) / sd AS z, 0.6745 * (x - med) / mad AS mz FROM s JOIN a USING (symbol) JOIN m USING (symbol) WHERE mad > 0) SELECT symbol, i, ts_ms, n, {rr('med', 'median')}, {rr('mad', 'mad')}, {rr('z', 'z')}, {rr('mz', 'modified_z')} FROM z WHERE abs(z) > 2 OR abs(mz) > 2.5").replace(") ,", "),", 1))
    dd = f""", e AS (SELECT symbol, i, ts_ms, sum(x) OVER w AS e FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i)), t AS (SELECT *, max(e) OVER (PARTITION BY symbol ORDER BY i) AS top FROM e),
p AS (SELECT *, sum((e >= top)::INT) OVER (PARTITION BY symbol ORDER BY i) AS peak, min(CASE WHEN e >= top THEN ts_ms END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms FROM t),
g AS (SELECT symbol, peak, count(*) AS c, min(i) AS peak_i, min(ts_ms) AS peak_ms, arg_min(i, {{'d': e - top, 'i': i}}) FILTER (e < top) AS trough_i, arg_min(ts_ms, {{'d': e - top, 'i': i}}) FILTER (e < top) AS trough_ms, min(e - top) AS depth, arg_max(next_ms, i) AS recovered_ms FROM p GROUP BY symbol, peak HAVING count(*) > 1)"""
    out["drawdown_episodes"] = (_on_bars(anom.drawdown_episodes), _with(f"{dd} SELECT symbol, peak_i, peak_ms, trough_i, trough_ms, {rr('depth', 'depth')}, recovered_ms FROM g").replace(") ,", "),", 1))
    q = lambda p, n: rr(f"coalesce(quantile_cont(depth, {p}) FILTER (recovered_ms IS NOT NULL), 0)", n)
    out["drawdown"] = (_on_bars(anom.drawdown), _with(f"{dd} SELECT symbol, {rr('min(depth)', 'max_dd')}, count(recovered_ms) AS n, {q(0.5, 'dd_p50')}, {q(0.95, 'dd_p95')}, {q(0.99, 'dd_p99')}, max(trough_ms - peak_ms) FILTER (recovered_ms IS NOT NULL) AS longest_fall_ms, max(recovered_ms - trough_ms) AS longest_recovery_ms FROM g GROUP BY symbol").replace(") ,", "),", 1))
    kp = f"""WITH b AS ({BARS}), s AS ({LEVELS}), e AS (SELECT symbol, i, x - avg(x) OVER w AS e, count(*) OVER w AS n, CAST(floor(4 * pow(count(*) OVER w / 100.0, 0.25)) AS INT) AS l FROM s WINDOW w AS (PARTITION BY symbol)),
r AS (SELECT *, sum(e) OVER (PARTITION BY symbol ORDER BY i) AS run FROM e), a AS (SELECT symbol, n, l, sum(run * run) AS ss, sum(e * e) AS g0 FROM r GROUP BY ALL),
v AS (SELECT x.symbol, sum(2 * (1 - k.j / (x.l + 1.0)) * x.e * y.e) AS g FROM e x JOIN (SELECT unnest(range(1, 50)) AS j) k ON k.j <= x.l JOIN e y ON y.symbol = x.symbol AND y.i = x.i - k.j GROUP BY x.symbol),
t AS (SELECT symbol, n, l, ss / (n * (g0 + coalesce(g, 0))) AS eta FROM a LEFT JOIN v USING (symbol) WHERE g0 + coalesce(g, 0) > 0)
SELECT symbol, n, l AS lag_truncation, {rr('eta', 'eta')}, round(CASE WHEN eta <= 0.347 THEN 0.1 WHEN eta <= 0.463 THEN 0.1 + (eta - 0.347) / (0.463 - 0.347) * (0.05 - 0.1) WHEN eta <= 0.574 THEN 0.05 + (eta - 0.463) / (0.574 - 0.463) * (0.025 - 0.05) WHEN eta <= 0.739 THEN 0.025 + (eta - 0.574) / (0.739 - 0.574) * (0.01 - 0.025) ELSE 0.01 END, 6) + 0.0 AS p_value FROM t"""
    out["kpss"] = (_on_bars(anom.kpss), kp)
    out["kpss_trend"] = (_on_bars(anom.kpss, "ct"), None)
    out["variance_ratio"] = (_on_bars(anom.variance_ratio, p_values=False), _vr_sql())
    out["variance_ratio_p_values"] = (_on_bars(anom.variance_ratio), None)
    out["ou_halflife"] = (_on_bars(anom.ou_halflife), _with(f", p AS (SELECT symbol, lag(x) OVER w AS l, x - lag(x) OVER w AS d FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i)), g AS (SELECT symbol, count(*) AS nobs, regr_slope(d, l) AS rho, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy FROM p WHERE l IS NOT NULL GROUP BY symbol HAVING count(*) >= 29), h AS (SELECT *, CASE WHEN rho > -1 AND rho < 0 THEN -0.6931471805599453 / ln(1 + rho) END AS hl FROM g) SELECT symbol, nobs, {rr('rho', 'ar1_coeff')}, {rr('rho / sqrt(greatest(syy - rho * sxy, 0) / (nobs - 2) / sxx)', 'ar1_t_stat')}, {rr('hl', 'half_life')}, {rr('coalesce(0.6931471805599453 / hl, 0)', 'lambda')} FROM h", s=LEVELS).replace(") ,", "),", 1))
    ts = f""", v AS (SELECT symbol, i, x, stddev_samp(x) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sd, stddev_samp(x) OVER (PARTITION BY symbol) AS all_sd, count(*) OVER (PARTITION BY symbol) AS n FROM s),
y AS (SELECT symbol, n, i, x / coalesce(nullif(sd, 0), all_sd) AS x FROM v), bl AS (SELECT symbol, n, k, i // k AS block, sum(x) AS y FROM y, (SELECT unnest([1, 5, 10, 20]) AS k) WHERE n >= 4 * k AND (i // k + 1) * k <= n GROUP BY ALL),
pr AS (SELECT *, lag(y) OVER (PARTITION BY symbol, k ORDER BY block) AS x FROM bl), g AS (SELECT symbol, n, k, count(*) AS m, regr_slope(y, x) AS coef, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg((x * y > 0)::INT) AS hit_rate, avg(sign(x) * y) AS tsmom_mean FROM pr WHERE x IS NOT NULL GROUP BY ALL),
z AS (SELECT *, coef / sqrt(greatest(syy - coef * sxy, 0) / (m - 2) / sxx) AS t FROM g)"""
    out["tsmom"] = (_on_bars(anom.tsmom, p_values=False), _with(f"{ts} SELECT symbol, n, k, m, {rr('coef', 'coef')}, {rr('t', 't_stat')}, {_n('hit_rate', 'tsmom_mean')}, {rr('1.0 / k', 'turnover')}, row_number() OVER (PARTITION BY symbol ORDER BY coef > 0 DESC, CASE WHEN coef > 0 THEN t ELSE abs(t) END DESC, k) = 1 AS selected FROM z").replace(") ,", "),", 1))
    out["tsmom_p_values"] = (_on_bars(anom.tsmom), None)
    k0 = f", p AS (SELECT symbol, lag(x) OVER w AS l, x - lag(x) OVER w AS d FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i)), g AS (SELECT symbol, count(*) AS nobs, regr_slope(d, l) AS rho, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy FROM p WHERE l IS NOT NULL GROUP BY symbol), t AS (SELECT *, rho / sqrt((syy - rho * sxy) / (nobs - 2) / sxx) AS tau FROM g) SELECT symbol, nobs, 0 AS lag_selected, {rr('tau', 'tau')} FROM t"
    out["adf_lag0"] = (_query(lambda s, d: anom.adf(event_bars(s, d), K, 0, "c", None).drop("p_value")), _with(k0, s=LEVELS).replace(") ,", "),", 1))
    out["adf"] = (_on_bars(anom.adf), None)
    out["arch_lm"] = (_on_bars(anom.arch_lm), None)
    out["cusum_break"] = (_on_bars(anom.cusum_break, min_segment=20, threshold=0.9), None)
    out["align_join"] = (lambda s, d: rounded(pair(s, d)), f"WITH {PAIR} SELECT pair, ts_ms, {_n('a', 'b')} FROM p")
    ww = "OVER (ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    out["pearson_rolling"] = (_on_pair(cross.pearson_rolling, 20), f"WITH {PAIR}, c AS (SELECT pair, i, first_value(ts_ms) {ww} AS window_start_ms, covar_pop(ra, rb) {ww} / sqrt(var_pop(ra) {ww} * var_pop(rb) {ww}) AS r FROM q) SELECT pair, i, window_start_ms, {rr('r', 'r')}, (abs(r) > 0.7)::INT AS crossing FROM c WHERE i >= 19")
    sp = f"WITH {PAIR}, x AS (SELECT a.pair, a.i AS e, b.i, b.ts_ms, rank() OVER (PARTITION BY a.i ORDER BY b.ra) + (count(*) OVER (PARTITION BY a.i, b.ra) - 1) / 2.0 AS ka, rank() OVER (PARTITION BY a.i ORDER BY b.rb) + (count(*) OVER (PARTITION BY a.i, b.rb) - 1) / 2.0 AS kb FROM q a JOIN q b ON b.i BETWEEN a.i - 19 AND a.i WHERE a.i >= 19), c AS (SELECT pair, e AS i, min(ts_ms) AS window_start_ms, corr(ka, kb) AS rho FROM x GROUP BY pair, e) SELECT pair, i, window_start_ms, {rr('rho', 'rho')}, (abs(rho) > 0.7)::INT AS crossing FROM c"
    out["spearman_rolling"] = (_on_pair(cross.spearman_rolling, 20), sp)
    out["ols_rolling"] = (_on_pair(cross.ols_rolling, 20), f"WITH {PAIR}, c AS (SELECT pair, i, first_value(ts_ms) {ww} AS window_start_ms, regr_slope(ra, rb) {ww} AS beta, regr_intercept(ra, rb) {ww} AS alpha, regr_syy(ra, rb) {ww} AS syy, regr_sxy(ra, rb) {ww} AS sxy FROM q), d AS (SELECT *, greatest(syy - beta * sxy, 0) AS ssr FROM c WHERE i >= 19) SELECT pair, i, window_start_ms, {_n('beta', 'alpha')}, {rr('1 - ssr / syy', 'r2')}, {rr('sqrt(ssr / 18)', 'residual_std')} FROM d")
    ll = f"WITH {PAIR}, g AS (SELECT count(*) AS n, avg(ra) AS ma, avg(rb) AS mb, stddev_pop(ra) AS sa, stddev_pop(rb) AS sb FROM q), c AS (SELECT x.pair, any_value(n) AS n, CAST(k.lag AS INT) AS lag, avg((x.ra - ma) * (y.rb - mb)) / (any_value(sa) * any_value(sb)) AS ccf FROM q x, g, (SELECT unnest(range(-20, 21)) AS lag) k, q y WHERE y.i = x.i + k.lag GROUP BY x.pair, k.lag) SELECT pair, n, lag, {rr('ccf', 'ccf')}, row_number() OVER (ORDER BY abs(ccf) DESC, lag) = 1 AS best FROM c"
    out["lead_lag"] = (_on_pair(cross.lead_lag, 20), ll)
    out["engle_granger"] = (_on_pair(cross.engle_granger), EG.format(head=f"WITH {PAIR}", k="pair", p="p") + f" SELECT pair, n, {_n('hedge_ratio', 'alpha', 'adf_stat', 'ou_half_life', 'residual_std', 'adf_p')} FROM u")
    head = f"WITH {PAIR}, w AS (SELECT p.pair, CAST(k.j AS BIGINT) AS window_index, p.i, p.ts_ms, p.a, p.b FROM p, (SELECT unnest(range(0, (SELECT CASE WHEN count(*) < 60 THEN 0 ELSE (count(*) - 60) // 20 + 1 END FROM p))) AS j) k WHERE p.i >= k.j * 20 AND p.i < k.j * 20 + 60)"
    cr = EG.format(head=head, k="pair, window_index", p="w") + f""", n AS (SELECT pair, window_index, min(ts_ms) AS window_start_ms, max(ts_ms) AS window_end_ms FROM w GROUP BY ALL),
c AS (SELECT u.*, coalesce(max((adf_p < 0.05)::INT) OVER (ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was, median(abs(hedge_ratio)) OVER (ORDER BY window_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mid, count(*) OVER (ORDER BY window_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS held FROM u)
SELECT pair, window_index, n, {_n('hedge_ratio', 'alpha', 'adf_stat', 'ou_half_life', 'residual_std', 'adf_p')}, window_start_ms, window_end_ms, (was = 1 AND adf_p > 0.1)::INT + 2 * coalesce((held >= 5 AND mid > 1e-9 AND (abs(hedge_ratio) > mid * 1.25 OR abs(hedge_ratio) < mid * 0.75))::INT, 0) AS reason_code FROM c JOIN n USING (pair, window_index)"""
    out["cointegration_rolling"] = (_on_pair(cross.cointegration_rolling, 60, 20), cr)
    out["seas_hour_of_day"] = (_on_bars(seas.bucket_scan, "hour_of_day"), _buckets(HOUR_SQL, "[CAST(x AS INT) for x in range(24)]"))
    out["seas_day_of_week"] = (_on_bars(seas.bucket_scan, "day_of_week"), _buckets(DAY_SQL, "[CAST(x AS INT) for x in range(7)]"))
    sess = "JOIN (VALUES ('asia', 22, 7), ('london', 7, 16), ('ny', 12, 21), ('overlap', 12, 16)) v(name, h0, h1) ON CASE WHEN h0 <= h1 THEN {h} >= h0 AND {h} < h1 ELSE {h} >= h0 OR {h} < h1 END".format(h=HOUR_SQL)
    out["seas_session"] = (_on_bars(seas.bucket_scan, "session"), _buckets("v.name", "['asia', 'london', 'ny', 'overlap']", join=sess))
    labels = "['EOM-3', 'EOM-2', 'EOM-1', 'SOM-1', 'SOM-2', 'SOM-3']"
    out["seas_eom_som"] = (_query(lambda s, d: seas.bucket_scan(order_bars(s, d), K, "eom_som")), _buckets("e.bucket", labels, ORDERS, f"LEFT JOIN e ON e.day = s.ts_ms // {DAY}", EDGES))
    an = f"""WITH b AS ({BARS}), s AS ({_returns()}), k AS (SELECT symbol, x, {DAY_SQL} AS g, avg(x) OVER (PARTITION BY symbol) AS mean FROM s QUALIFY count(*) OVER (PARTITION BY symbol, g) >= 5),
gs AS (SELECT symbol, g, count(*) AS m, avg(x) AS gm, var_pop(x) * count(*) AS ss FROM k GROUP BY ALL), gm AS (SELECT symbol, avg(x) AS mean, count(*) AS n FROM k GROUP BY symbol),
f AS (SELECT symbol, any_value(n) AS n, count(*) AS k, sum(m * (gm - mean) * (gm - mean)) AS ssb, sum(ss) AS ssw FROM gs JOIN gm USING (symbol) GROUP BY symbol HAVING count(*) >= 2),
rk AS (SELECT symbol, g, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY symbol, x) AS c FROM k),
rs AS (SELECT symbol, sum(rs * rs / m) AS rr FROM (SELECT symbol, g, sum(rk) AS rs, count(*) AS m FROM rk GROUP BY ALL) GROUP BY symbol), ti AS (SELECT symbol, sum(c * c - 1.0) AS tie FROM rk GROUP BY symbol),
o AS (SELECT symbol, n, k, (ssb / (k - 1)) / (ssw / (n - k)) AS f, (12.0 / (n * (n + 1.0)) * rr - 3 * (n + 1)) / (1 - tie / (n * 1.0 * n * n - n)) AS h FROM f JOIN rs USING (symbol) JOIN ti USING (symbol))
SELECT symbol, n, k, {rr('f', 'f_stat')}, {rr('h', 'kw_stat')}, {rr('CASE WHEN (k - 1) * (f - 1) + n > 0 THEN (k - 1) * (f - 1) / ((k - 1) * (f - 1) + n) ELSE 0 END', 'omega_squared')} FROM o"""
    out["seas_anova_kruskal"] = (_on_bars(seas.anova_kruskal, "day_of_week", p_values=False), an)
    out["seas_anova_kruskal_p_values"] = (_on_bars(seas.anova_kruskal, "session"), None)
    ev = f"""WITH b AS ({BARS}), s AS ({_returns()}), ev(event_ms) AS (VALUES {TS_VALUES}), n AS (SELECT symbol, max(i) + 1 AS n FROM s GROUP BY symbol), hit AS (SELECT s.symbol, event_ms, min(i) AS i FROM s JOIN ev ON s.ts_ms >= event_ms GROUP BY ALL)
SELECT hit.symbol, event_ms, hit.i, round(avg(x) FILTER (s.i < hit.i), 6) + 0.0 AS pre_mean, round(stddev_samp(x) FILTER (s.i < hit.i), 6) + 0.0 AS pre_std, round(avg(x) FILTER (s.i >= hit.i), 6) + 0.0 AS post_mean, round(stddev_samp(x) FILTER (s.i >= hit.i), 6) + 0.0 AS post_std
FROM hit JOIN n USING (symbol) JOIN s ON s.symbol = hit.symbol AND s.i >= hit.i - 5 AND s.i < hit.i + 5 WHERE hit.i >= 5 AND hit.i + 5 <= n.n GROUP BY ALL"""
    out["seas_event_window"] = (_query(lambda s, d: seas.event_window(event_bars(s, d), K, s.createDataFrame([(e,) for e in EVENTS], "event_ms long"))), ev)
    out["overnight_gaps"] = (_query(lambda s, d: seas.overnight_gaps(event_bars(s, d), K, HOUR)), _gaps_sql(f"SELECT symbol, ts_ms, {rr('size', 'size')}, direction, bucket, bars_to_fill FROM x"))
    out["overnight_gap_table"] = (_query(lambda s, d: seas.gap_table(seas.overnight_gaps(event_bars(s, d), K, HOUR), K)), _gaps_sql(f", d AS (SELECT symbol, direction, CAST(bucket AS INT) AS bucket FROM (SELECT DISTINCT symbol FROM x), (SELECT unnest(['up', 'down']) AS direction), (SELECT unnest(range(4)) AS bucket)), gt AS (SELECT symbol, direction, bucket, count(*) AS c, count(bars_to_fill) AS f FROM x GROUP BY ALL) SELECT d.symbol, d.direction, d.bucket, coalesce(c, 0) AS count, coalesce(f, 0) AS fills, CASE WHEN c >= 5 THEN round(f / c, 6) + 0.0 END AS fill_prob FROM d LEFT JOIN gt USING (symbol, direction, bucket)").replace(") , d AS", "), d AS"))
    qq = ", ".join(rr(f"quantile_cont(abs(size), {p})", f"p{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9))
    out["overnight_gap_headline"] = (_query(lambda s, d: seas.gap_headline(seas.overnight_gaps(event_bars(s, d), K, HOUR), K)), _gaps_sql(f"SELECT symbol, count(*) AS n, {rr('count(bars_to_fill) / count(*)', 'fill_rate')}, {qq}, {rr('median(bars_to_fill)', 'median_bars_to_fill')}, count(*) < 20 AS sparse_gaps FROM x GROUP BY symbol"))
    out["gap_detect"] = (_detected, f"WITH {MISSING} SELECT 'ALL' AS symbol, start_ms, end_ms, reason FROM gap")
    out["gap_effective_5m"] = (_effective, f"WITH {RUNS} SELECT 'ALL' AS symbol, start_ms, end_ms, reason FROM eff")
    seg = f"""WITH {RUNS}, mi AS (SELECT *, sum(CASE WHEN start_ms <= reach THEN 0 ELSE 1 END) OVER (ORDER BY start_ms, end_ms) AS island FROM (SELECT *, max(end_ms) OVER (ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM eff)),
mr AS (SELECT min(start_ms) AS a, max(end_ms) AS z FROM mi GROUP BY island UNION ALL SELECT {END}, {END}), sg AS (SELECT coalesce(lag(z) OVER (ORDER BY a, z), {START}) AS f, a AS t FROM mr)
SELECT 'ALL' AS symbol, CAST(row_number() OVER (ORDER BY f) AS INT) AS segment, f AS start_ms, t AS end_ms FROM (SELECT (f + {5 * MINUTE} - 1) // {5 * MINUTE} * {5 * MINUTE} AS f, t // {5 * MINUTE} * {5 * MINUTE} AS t FROM sg) WHERE f < t"""
    out["gap_segments_5m"] = (_segments, seg)
    out["gap_strict"] = (lambda s, d: gaps.aborted(_effective(s, d), K, *_days(s, d)), f"WITH {RUNS} SELECT 'ALL' AS symbol, count(*) AS n_gaps FROM eff WHERE end_ms > {START} AND start_ms < {END} HAVING count(*) > 0")
    pg = f"""WITH {SPAN}, b AS ({_bars('events', 5 * MINUTE)}), m AS (SELECT ms FROM (SELECT ms, to_timestamp(ms / 1000)::DATE AS d FROM (SELECT unnest(range({START}, {END}, {5 * MINUTE})) AS ms)) WHERE {IS_OPEN}),
g AS (SELECT ms AS a, ms + {5 * MINUTE} AS z FROM m, (SELECT unnest(['click', 'view']) AS symbol) s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = s.symbol AND b.ts_ms = m.ms)),
i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (ORDER BY a, z) AS island FROM (SELECT DISTINCT a, z, max(z) OVER (ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT a, z FROM g)))
SELECT 'click/view' AS pair, min(a) AS start_ms, max(z) AS end_ms, 2 AS reason FROM i GROUP BY island"""
    out["gap_pair_union"] = (_pair_gaps, pg)
    fd = f"""WITH b AS ({BARS}), s AS ({_returns()}), m AS (SELECT symbol, count(*) AS n, skewness(x) AS w, kurtosis(x) AS k FROM s GROUP BY symbol HAVING count(*) >= 4), h AS (SELECT symbol, {HOUR_SQL} AS g, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM s GROUP BY ALL HAVING count(*) >= 5),
p AS (SELECT symbol, 'stats' AS family, exp(-n / 6.0 * (w * w + k * k / 4) / 2) AS p_value FROM m UNION ALL SELECT symbol || '/' || g, 'seas', exp(-abs(t)) FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY family) AS c FROM p)
SELECT symbol, family, {rr('p_value', 'p_value')}, round(min(least(p_value * c / rk, 1.0)) OVER (PARTITION BY family ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS fdr_q FROM r"""
    out["fdr_benjamini_hochberg"] = (_fdr, fd)
    out["cliffs_delta"] = (_cliffs, _with(f", h AS (SELECT symbol, x, {HOUR_SQL} < 12 AS a FROM s) SELECT l.symbol, round(sum(sign(r.x - l.x)) / count(*), 6) + 0.0 AS delta FROM h l JOIN h r ON l.symbol = r.symbol AND l.a AND NOT r.a GROUP BY l.symbol").replace(") ,", "),", 1))
    out["bootstrap_stationary"] = (_bootstrap, None)
    out["null_phase_scramble"] = (_null, None)
    out["null_pair_circular_shift"] = (_pair_null, None)
    return out


def queries() -> dict:
    return {k: q for k, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _entries().items() if s}
