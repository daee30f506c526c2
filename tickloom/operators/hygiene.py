"""Resampling statistics (bootstrap intervals, null p-values), effect sizes and false discovery rates.

Resamples are dealt out in chunks: each (key, chunk) is a group of its own with its own random stream, so a run's
numbers depend on the seed and not on the cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import dist
from tickloom.operators import kernels

MOST_RESAMPLES = 100_000


def resamples(n: int | None) -> int:
    n = n or 1000
    if n > MOST_RESAMPLES:
        raise ValueError(f"more than {MOST_RESAMPLES} resamples")
    return n


def auto_block(x: np.ndarray) -> float:
    """Block length by the flat-top rule of Politis, White and Patton; NaN for short or constant series."""
    n = len(x)
    if n < 4:
        return math.nan
    c = x - x.mean()
    most = math.ceil(min(5 * math.log10(n), n / 2))
    acov = np.array([float((c[: n - k] * c[k:]).sum()) / n for k in range(most + 1)])
    if acov[0] == 0:
        return math.nan
    strong = np.flatnonzero(np.abs(acov[1:] / acov[0]) > 2 * math.sqrt(math.log10(n) / n))
    width = 2 * (int(strong[-1]) + 1 if len(strong) else 1)
    k = np.arange(width + 1)
    lam, r = 1 - k / width, np.zeros(width + 1)
    lam[0] = 1
    r[: min(len(acov), width + 1)] = acov[: width + 1]
    g, d = float((lam[1:] * k[1:] * r[1:]).sum()), 2 * float((lam * r).sum()) ** 2
    return (2 * g * g / d) ** (1 / 3) * n ** (1 / 3) if d else math.nan


def block_of(x: np.ndarray) -> float:
    auto = auto_block(x)
    return max(3.0, auto) if auto == auto else 3.0


def bootstrap_indices(rng: np.random.Generator, n: int, count: int, length: float, method: str) -> np.ndarray:
    """(count, n) places in a circular series: blocks of geometric length (stationary) or of one length (block)."""
    if method == "block":
        size = int(min(n, max(3, math.ceil(length))))
        starts = rng.integers(0, n, (count, -(-n // size)))
        return ((starts[:, :, None] + np.arange(size)) % n).reshape(count, -1)[:, :n]
    if method != "stationary":
        raise ValueError(f"unknown bootstrap {method!r}")
    fresh = rng.random((count, n)) < 1 / length
    fresh[:, 0] = True
    starts = rng.integers(0, n, (count, n))
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    return (np.take_along_axis(starts, at, axis=1) + np.arange(n) - at) % n


def phase_scramble(rng: np.random.Generator, x: np.ndarray, rounds: int = 10, near: float = 1.0) -> np.ndarray:
    """A surrogate with x's values and about its spectrum: random phases, then amplitude and rank steps in turn."""
    n, ordered = len(x), np.sort(x)
    amplitude = np.abs(np.fft.rfft(x))
    phases = np.exp(2j * np.pi * rng.random(len(amplitude)))
    phases[0] = 1
    y, ranks = np.fft.irfft(amplitude * phases, n), None
    for _ in range(rounds):
        now = np.argsort(np.argsort(y, kind="stable"), kind="stable")
        y = ordered[now]
        if ranks is not None and np.abs(now - ranks).mean() < near:
            break
        ranks, spectrum = now, np.fft.rfft(y)
        size = np.abs(spectrum)
        y = np.fft.irfft(amplitude * np.divide(spectrum, size, out=np.ones_like(spectrum), where=size > 0), n)
    return ordered[np.argsort(np.argsort(y, kind="stable"), kind="stable")]


def surrogate(rng: np.random.Generator, x: np.ndarray, method: str) -> np.ndarray:
    if method == "circular_shift":
        return np.roll(x, int(rng.integers(1, len(x)))) if len(x) > 1 else x
    if method == "phase_scramble":
        return phase_scramble(rng, x)
    raise ValueError(f"unknown null {method!r}")


def _ljung_box(x: np.ndarray, most: int = 10) -> float:
    n, c = len(x), x - x.mean()
    s, most = float((c * c).sum()), max(1, min(most, n // 5))
    return n * (n + 2) * sum((float((c[k:] * c[:-k]).sum()) / s) ** 2 / (n - k) for k in range(1, most + 1)) if s else 0.0


def _moments(x: np.ndarray) -> tuple[float, float]:
    n, c = len(x), x - x.mean()
    v = float((c * c).mean())
    if n < 4 or v == 0:
        return 0.0, 0.0
    g1, g2 = float((c**3).mean()) / v**1.5, float((c**4).mean()) / v**2 - 3
    return g1 * math.sqrt(n * (n - 1)) / (n - 2), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def _jarque_bera(x: np.ndarray) -> float:
    a, b = _moments(x)
    return len(x) / 6 * (a * a + b * b / 4)


def _kpss(x: np.ndarray, regression: str = "c", nlags: int | str = "auto") -> float:
    n, e = len(x), x - x.mean()
    if regression == "ct":
        t = np.arange(n) - (n - 1) / 2
        e = e - t * float(t @ e) / float(t @ t)
    l = math.floor(4 * (n / 100) ** 0.25) if nlags == "auto" else min(int(nlags), n - 1)  # noqa: E741
    lrv = float((e * e).sum()) / n + 2 * sum((1 - j / (l + 1)) * float((e[j:] * e[:-j]).sum()) / n for j in range(1, l + 1))
    return float((np.cumsum(e) ** 2).sum()) / (n * n * lrv) if lrv > 0 else math.nan


def _first(rows: list[dict], name: str) -> float:
    return float(rows[0][name]) if rows else math.nan


def _vr(x: np.ndarray, k: int = 16) -> float:
    n, c = len(x), x - x.mean()
    s = float((c * c).sum()) / (n - 1) if n > 1 else 0.0
    return float((np.convolve(c, np.ones(k), "valid") ** 2).sum()) / (k * (n - k + 1) * (1 - k / n)) / s if s and n >= 2 * k else math.nan


#: Scan id: (input series, statistic, tail); tail 1 upper, -1 lower, 0 both.
STATISTICS: dict[str, tuple[str, Callable, int]] = {
    "stats.summary.welford": ("log_returns", lambda x: float(x.mean()), 0),
    "stats.vol.rolling": ("log_returns", lambda x: float(x.std(ddof=1)), 0),
    "stats.autocorr.ljung_box": ("log_returns", _ljung_box, 1),
    "stats.autocorr.ljung_box_sq": ("log_returns", lambda x: _ljung_box(x * x), 1),
    "stats.stationarity.adf": ("close", lambda x: _first(kernels.adf(x, 0, "c", None), "tau"), -1),
    "stats.stationarity.kpss": ("close", _kpss, 1),
    "stats.variance_ratio.lo_mackinlay": ("log_returns", _vr, 0),
    "stats.heteroskedasticity.arch_lm": ("log_returns", lambda x: _first(kernels.arch_lm(x, 5), "lm"), 1),
    "stats.normality.jarque_bera": ("log_returns", _jarque_bera, 1),
}


def statistic(scan_id: str, params: dict) -> tuple[tuple[str, ...], Callable, int] | None:
    """(input columns, statistic, tail) of a scan with its resolved parameters; None if it has no statistic. The inputs
    of two legs are ra, rb (log returns) or a, b (closes)."""
    p = params
    if scan_id.startswith("cross."):
        made = _of_pair(scan_id, p)
        return (*made, 0) if made else None
    if scan_id not in STATISTICS:
        return None
    of, stat, tail = STATISTICS[scan_id]
    own = {
        "stats.vol.rolling": lambda x: float(x[-p["window"] :].std(ddof=1)) if len(x) >= p["window"] else math.nan,
        "stats.autocorr.ljung_box": lambda x: _ljung_box(x, p.get("most", 10)),
        "stats.autocorr.ljung_box_sq": lambda x: _ljung_box(x * x, p.get("most", 10)),
        "stats.stationarity.adf": lambda x: _first(kernels.adf(x, p.get("max_lag"), p.get("regression", "c"), p.get("autolag", "AIC")), "tau"),
        "stats.stationarity.kpss": lambda x: _kpss(x, p.get("regression", "c"), p.get("nlags", "auto")),
        "stats.variance_ratio.lo_mackinlay": lambda x: _vr(x, max(p.get("k_values", (16,)))),
        "stats.heteroskedasticity.arch_lm": lambda x: _first(kernels.arch_lm(x, p.get("lag", 5)), "lm"),
    }
    return (p.get("of") or of,), own.get(scan_id, stat), tail


def _slope(y: np.ndarray, x: np.ndarray) -> float:
    c = x - x.mean()
    return float(c @ y) / s if (s := float(c @ c)) else math.nan


def _pearson(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b) / s if (s := math.sqrt(float(a @ a) * float(b @ b))) else math.nan


def _best_lag(a: np.ndarray, b: np.ndarray, most: int) -> float:
    """The lag of the largest |ccf|; ties: the smallest."""
    a, b = a - a.mean(), b - b.mean()
    if len(a) < 4 or len(a) <= 2 * most or not a.any() or not b.any():
        return math.nan
    ccf = [float((a[: len(a) - k] * b[k:] if k >= 0 else a[-k:] * b[:k]).mean()) for k in range(-most, most + 1)]
    return float(np.argmax(np.abs(ccf)) - most)


def _of_pair(scan_id: str, p: dict) -> tuple[tuple[str, ...], Callable] | None:
    def last(stat: Callable) -> Callable:
        return lambda a, b: stat(a[-p["window"] :], b[-p["window"] :]) if len(a) >= p["window"] else math.nan

    ranks = lambda x: pd.Series(x).rank().to_numpy()
    returns = ("ra", "rb")
    return {
        "cross.corr.pearson_rolling": lambda: (returns, last(_pearson)),
        "cross.corr.spearman_rolling": lambda: (returns, last(lambda a, b: _pearson(ranks(a), ranks(b)))),
        "cross.ols.rolling": lambda: (returns, last(_slope)),
        "cross.lead_lag.ccf": lambda: (returns, lambda a, b: _best_lag(a, b, p.get("max_lag", 20))),
        "cross.cointegration.engle_granger": lambda: (("a", "b"), lambda a, b: _slope(a, b) if len(a) >= p.get("least", 30) else math.nan),
    }.get(scan_id, lambda: None)()


def _stream(seed: int, *parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *parts)).encode()).digest()[:16], "little"))


def _draws(s: DataFrame, keys: list[str], n: int, chunk: int, draw: Callable) -> DataFrame:
    """keys, observed and stat: n statistics a key. draw(rng, series, count) gives statistics, or the observed one at count 0."""
    schema = T.StructType([*(s.schema[k] for k in keys), T.StructField("observed", T.DoubleType()), T.StructField("stat", T.DoubleType())])
    dealt = s.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-n // chunk) - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        *who, part = key
        count = min(chunk, n - part * chunk)
        observed, got = draw(tuple(map(str, who)), part, pdf, count)
        return pd.DataFrame([[*who, observed, g] for g in got], columns=schema.names)

    return dealt.groupBy(*keys, "chunk").applyInPandas(run, schema)


def bootstrap_ci(s: DataFrame, keys: list[str], stat: Callable, n: int = 1000, method: str = "stationary", seed: int = 0, level: float = 0.95, chunk: int = 250, cols: tuple[str, ...] = ("x",)) -> DataFrame:
    """keys, observed, lo and hi: the percentile interval of stat over resampled series (all cols by the same places)."""
    n = resamples(n)

    def draw(who, part, pdf, count):
        xs = [pdf[c].to_numpy(float) for c in cols]
        at = bootstrap_indices(_stream(seed, who, part, method), len(xs[0]), count, block_of(xs[0]), method)
        return stat(*xs), [stat(*[x[i] for x in xs]) for i in at]

    got = _draws(s.select(*keys, "i", *cols), keys, n, chunk, draw).filter(~F.isnan("stat"))
    alpha = 1 - level
    g = got.groupBy(*keys).agg(F.first("observed").alias("observed"), F.array_sort(F.collect_list("stat")).alias("all"))
    m = F.size("all")
    return g.filter(m > 0).select(*keys, "observed", F.element_at("all", (F.floor(m * (alpha / 2)) + 1).cast("int")).alias("lo"), F.element_at("all", F.greatest(F.ceil(m * (1 - alpha / 2)), F.lit(1)).cast("int")).alias("hi"))


def null_p(s: DataFrame, keys: list[str], stat: Callable, tail: int, n: int = 1000, method: str = "circular_shift", seed: int = 0, chunk: int = 250, cols: tuple[str, ...] = ("x",)) -> DataFrame:
    """keys, observed and p_value = (1 + surrogates as extreme) / (1 + n). Of two legs only the second is resampled."""
    n = resamples(n)

    def draw(who, part, pdf, count):
        xs, rng = [pdf[c].to_numpy(float) for c in cols], _stream(seed, who, part, method)
        return stat(*xs), [stat(*xs[:-1], surrogate(rng, xs[-1], method)) for _ in range(count)]

    got = _draws(s.select(*keys, "i", *cols), keys, n, chunk, draw)
    o, t = F.col("observed"), F.col("stat")
    extreme = t >= o if tail > 0 else t <= o if tail < 0 else F.abs(t) >= F.abs(o)
    return got.groupBy(*keys).agg(F.first("observed").alias("observed"), ((F.sum(extreme.cast("long")) + 1) / (F.count("*") + 1)).alias("p_value"))


def family_of(scan: Column, kind: str) -> Column | None:
    """The family key of scan@version names; None says that there is no correction."""
    if kind == "none":
        return None
    return {"all": F.lit("all"), "scan_family": F.substring_index(scan, ".", 1)}.get(kind, scan)


def fdr(findings: DataFrame, family: str = "family", p: str = "p_value") -> DataFrame:
    """Adds fdr_q by Benjamini and Hochberg within each family; null and NaN p-values get none and do not count."""
    ok = F.col(p).isNotNull() & ~F.isnan(F.coalesce(F.col(p), F.lit(float("nan"))))
    w = Window.partitionBy(family, "__ok").orderBy(p)
    f = findings.withColumn("__ok", ok).withColumn("__rank", F.row_number().over(w)).withColumn("__m", F.count("*").over(Window.partitionBy(family, "__ok")))
    q = F.min(F.least(F.col(p) * F.col("__m") / F.col("__rank"), F.lit(1.0))).over(Window.partitionBy(family, "__ok").orderBy("__rank").rowsBetween(0, Window.unboundedFollowing))
    return f.withColumn("fdr_q", F.when(F.col("__ok"), q)).drop("__ok", "__rank", "__m")


def cohens_d(a: Column, b: Column, sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    """(b - a) over the pooled standard deviation, from means, deviations and counts."""
    return F.try_divide(b - a, F.sqrt(F.try_divide((na - 1) * sa * sa + (nb - 1) * sb * sb, na + nb - 2)))


def hedges_g(d: Column, n: Column) -> Column:
    return d * (1 - 3.0 / (4 * n - 9))


def cliffs_delta(df: DataFrame, keys: list[str], side: str = "side", x: str = "x") -> DataFrame:
    """delta = (pairs with b > a - pairs with b < a) / pairs, from ranks: sides are 'a' and 'b'. No pairs are made."""
    g = df.groupBy(*keys, x).agg(F.sum((F.col(side) == "a").cast("long")).alias("na"), F.sum((F.col(side) == "b").cast("long")).alias("nb"))
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("na").over(w), F.lit(0)))
    s = g.groupBy(*keys).agg(F.sum(F.col("nb") * F.col("below")).alias("more"), F.sum(F.col("nb") * F.col("na")).alias("ties"), F.sum("na").alias("a"), F.sum("nb").alias("b"))
    pairs = F.col("a") * F.col("b")
    return s.select(*keys, F.try_divide(2 * F.col("more") + F.col("ties") - pairs, pairs).alias("delta"))


__all__ = ["STATISTICS", "auto_block", "bootstrap_ci", "cliffs_delta", "cohens_d", "dist", "fdr", "family_of", "hedges_g", "null_p", "phase_scramble", "statistic", "surrogate"]
