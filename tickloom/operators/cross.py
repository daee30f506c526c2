"""Scans of two instruments. Pairs are rows (keys, ts_ms, a, b) of closes at the moments that both legs have; a is y, b is x."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import indexed, over


def pair_returns(pairs: DataFrame, keys: list[str]) -> DataFrame:
    w = over(keys)
    p = pairs.select(*keys, "ts_ms", F.log(F.col("a") / F.lag("a").over(w)).alias("ra"), F.log(F.col("b") / F.lag("b").over(w)).alias("rb"))
    return indexed(p.filter("ra IS NOT NULL AND rb IS NOT NULL"), keys)


def _corr(a: str, b: str, w=None) -> Column:
    """Pearson's r; null without variance (an error in ANSI mode for the built-in)."""
    o = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return F.try_divide(o(F.covar_pop(a, b)), F.sqrt(o(F.var_pop(a)) * o(F.var_pop(b))))


def pearson_rolling(pairs: DataFrame, keys: list[str], window: int, threshold: float = 0.7) -> DataFrame:
    """A row a full window: i, window_start_ms, r and crossing (1 if |r| is over the threshold)."""
    if window < 3:
        raise ValueError("window is under 3")
    w = over(keys, "i").rowsBetween(-(window - 1), 0)
    p = pair_returns(pairs, keys).select(*keys, "i", F.first("ts_ms").over(w).alias("window_start_ms"), _corr("ra", "rb", w).alias("r"))
    return p.filter(F.col("i") >= window - 1).withColumn("crossing", (F.abs("r") > threshold).cast("int"))


def spearman_rolling(pairs: DataFrame, keys: list[str], window: int, threshold: float = 0.7) -> DataFrame:
    """As pearson_rolling over ranks within each window (ties share the mean rank).

    A row's rank in its window is counted from the window's own array, so only a frame of `window` values is held.
    """
    if window < 3:
        raise ValueError("window is under 3")
    w = over(keys, "i").rowsBetween(-(window - 1), 0)
    p = pair_returns(pairs, keys).select(*keys, "i", F.first("ts_ms").over(w).alias("window_start_ms"), F.collect_list("ra").over(w).alias("xa"), F.collect_list("rb").over(w).alias("xb"))
    p = p.filter(F.col("i") >= window - 1)

    def ranks(xs: str) -> Column:
        return F.transform(xs, lambda v: F.size(F.filter(xs, lambda u: u < v)) + (F.size(F.filter(xs, lambda u: u == v)) + 1) / 2.0)

    mid = (window + 1) / 2.0
    c = p.select(*keys, "i", "window_start_ms", F.transform(ranks("xa"), lambda x: x - mid).alias("ca"), F.transform(ranks("xb"), lambda x: x - mid).alias("cb"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    rho = F.try_divide(dot("ca", "cb"), F.sqrt(dot("ca", "ca") * dot("cb", "cb")))
    return c.select(*keys, "i", "window_start_ms", rho.alias("rho")).withColumn("crossing", (F.abs("rho") > threshold).cast("int"))


def ols_rolling(pairs: DataFrame, keys: list[str], window: int) -> DataFrame:
    """A row a full window: beta, alpha, r2 and residual_std of ra on rb."""
    if window < 3:
        raise ValueError("window is under 3")
    w = over(keys, "i").rowsBetween(-(window - 1), 0)
    p = pair_returns(pairs, keys).select(
        *keys, "i", F.first("ts_ms").over(w).alias("window_start_ms"), F.regr_slope("ra", "rb").over(w).alias("beta"), F.regr_intercept("ra", "rb").over(w).alias("alpha"),
        F.regr_syy("ra", "rb").over(w).alias("syy"), F.regr_sxy("ra", "rb").over(w).alias("sxy"),
    )
    p = p.filter(F.col("i") >= window - 1)
    ssr = F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0))
    return p.select(*keys, "i", "window_start_ms", "beta", "alpha", (1 - F.try_divide(ssr, "syy")).alias("r2"), F.sqrt(ssr / (window - 2)).alias("residual_std"))


def lead_lag(pairs: DataFrame, keys: list[str], max_lag: int = 20) -> DataFrame:
    """A row a lag from -max_lag to max_lag: ccf; a leads at positive lags. best marks the largest |ccf| (ties: the smallest lag)."""
    r = pair_returns(pairs, keys)
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ra").alias("ma"), F.avg("rb").alias("mb"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    g = g.filter((F.col("n") >= 4) & (F.col("n") > 2 * max_lag))
    r = r.join(g, keys).withColumn("ca", F.col("ra") - F.col("ma")).withColumn("cb", F.col("rb") - F.col("mb"))
    w = over(keys, "i")
    cols = [(k, F.col("ca") * (F.lead("cb", k).over(w) if k > 0 else F.lag("cb", -k).over(w) if k < 0 else F.col("cb"))) for k in range(-max_lag, max_lag + 1)]
    r = r.select(*keys, "n", "sa", "sb", *[c.alias(f"p{j}") for j, (_, c) in enumerate(cols)])
    s = r.groupBy(*keys, "n", "sa", "sb").agg(*[F.avg(f"p{j}").alias(f"m{j}") for j in range(len(cols))])
    rows = s.select(*keys, "n", "sa", "sb", F.posexplode(F.array(*[F.col(f"m{j}") for j in range(len(cols))])).alias("pos", "m"))
    rows = rows.select(*keys, "n", (F.col("pos") - max_lag).alias("lag"), F.try_divide("m", F.col("sa") * F.col("sb")).alias("ccf"))
    return rows.withColumn("best", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs("ccf").desc_nulls_last(), "lag")) == 1)


def dickey_fuller_p(tau: Column) -> Column:
    """Piecewise between -3.43, -2.86 and -2.57."""
    return (
        F.when(tau <= -3.43, 0.01 * F.exp(tau + 3.43)).when(tau <= -2.86, 0.01 + (tau + 3.43) / 0.57 * 0.04).when(tau <= -2.57, 0.05 + (tau + 2.86) / 0.29 * 0.05).when(tau < 0, 0.10 + (tau + 2.57) / 2.57 * 0.90).otherwise(1.0)
    )


def engle_granger(pairs: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """n, hedge_ratio (beta), alpha, adf_stat, adf_p, ou_half_life (null: infinite) and residual_std."""
    return _engle_granger(indexed(pairs, keys), keys, least)


def _engle_granger(p: DataFrame, keys: list[str], least: int) -> DataFrame:
    fit = p.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("a", "b").alias("beta"), F.regr_intercept("a", "b").alias("alpha")).filter((F.col("n") >= least) & F.col("beta").isNotNull())
    e = p.join(fit, keys).withColumn("e", F.col("a") - F.col("alpha") - F.col("beta") * F.col("b"))
    e = e.withColumn("e1", F.lag("e").over(over(keys, "i"))).withColumn("d", F.when(F.col("e1").isNotNull(), F.col("e") - F.col("e1")))
    g = e.groupBy(*keys, "n", "beta", "alpha").agg(
        F.stddev_samp("e").alias("residual_std"), F.count("d").alias("m"), F.regr_slope("d", "e1").alias("rho"), F.regr_sxx("d", "e1").alias("sxx"), F.regr_syy("d", "e1").alias("syy"), F.regr_sxy("d", "e1").alias("sxy"),
    )
    ssr = F.greatest(F.col("syy") - F.col("rho") * F.col("sxy"), F.lit(0.0))
    tau = F.try_divide("rho", F.sqrt(F.try_divide(ssr / (F.col("m") - 2), "sxx")))
    half = F.when((F.col("rho") > -1) & (F.col("rho") < 0), -F.lit(math.log(2)) / F.log1p("rho"))
    g = g.select(*keys, "n", F.col("beta").alias("hedge_ratio"), "alpha", tau.alias("adf_stat"), half.alias("ou_half_life"), "residual_std")
    return g.withColumn("adf_p", dickey_fuller_p(F.col("adf_stat")))


def cointegration_rolling(pairs: DataFrame, keys: list[str], window: int, step: int = 1, enter: float = 0.05, leave: float = 0.10, band: float = 0.25, least: int = 30) -> DataFrame:
    """Engle-Granger a window, and breakdowns: 1 the residuals were stationary in an earlier window and are no longer,
    2 the hedge ratio lies outside the band round the median of the last 20 windows (5 at least), 3 both, 0 neither.

    Each row is dealt to the windows that hold it, so windows are groups of one aggregation.
    """
    if window < least or step < 1:
        raise ValueError("window is under the least number of bars, or step under 1")
    p = indexed(pairs, keys)
    n = p.groupBy(*keys).agg(F.count("*").alias("total"))
    first = F.greatest(F.ceil((F.col("i") - window + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("total") - window) / step))
    p = p.join(n, keys).filter(F.col("total") >= window).withColumn("lo", first).withColumn("hi", last).filter("lo <= hi")
    p = p.select(*keys, "i", "ts_ms", "a", "b", F.explode(F.sequence("lo", "hi")).alias("window_index"))
    g = _engle_granger(p, [*keys, "window_index"], least)
    ends = p.groupBy(*keys, "window_index").agg(F.min("ts_ms").alias("window_start_ms"), F.max("ts_ms").alias("window_end_ms"))
    g = g.join(ends, [*keys, "window_index"])
    w = Window.partitionBy(*keys).orderBy("window_index")
    past, recent = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-20, -1)
    g = g.withColumn("was", F.coalesce(F.max((F.col("adf_p") < enter).cast("int")).over(past), F.lit(0)))
    g = g.withColumn("mid", F.percentile(F.abs("hedge_ratio"), F.lit(0.5)).over(recent)).withColumn("held", F.count("*").over(recent))
    lost = (F.col("was") == 1) & (F.col("adf_p") > leave)
    off = (F.col("held") >= 5) & (F.col("mid") > 1e-9) & ((F.abs("hedge_ratio") > F.col("mid") * (1 + band)) | (F.abs("hedge_ratio") < F.col("mid") * (1 - band)))
    code = F.coalesce(lost.cast("int"), F.lit(0)) + 2 * F.coalesce(off.cast("int"), F.lit(0))
    return g.withColumn("reason_code", code).drop("was", "mid", "held")
