"""Scans of one instrument. Each takes bars and their key columns and gives one row a key (or a row a window or break);
undefined values are null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import dist
from tickloom.functions.series import centred, indexed, lags, levels, over, returns, series
from tickloom.operators import kernels


def returns_profile(bars: DataFrame, keys: list[str], variant: str = "log") -> DataFrame:
    s = returns(bars, keys, variant)
    return s.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")).filter("n >= 2")


def moments(s: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, std and the bias-corrected skewness and excess kurtosis, from centred values; 0 without variance."""
    c = F.col("c")
    m = centred(s, keys).groupBy(*keys, "n", "mean").agg(F.sum(c * c).alias("m2"), F.sum(c * c * c).alias("m3"), F.sum(c * c * c * c).alias("m4"))
    n = F.col("n").cast("double")
    var = F.col("m2") / n
    g1 = F.try_divide(F.col("m3") / n, F.pow(var, F.lit(1.5)))
    g2 = F.try_divide(F.col("m4") / n, var * var) - 3
    skew = F.when((n >= 3) & (var > 0), g1 * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))).otherwise(0.0)
    kurt = F.when((n >= 4) & (var > 0), ((n + 1) * g2 + 6) * (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0))).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(F.try_divide(F.col("m2"), n - 1))).otherwise(0.0)
    return m.select(*keys, "n", "mean", std.alias("std"), skew.alias("skew"), kurt.alias("excess_kurtosis"))


def summary(bars: DataFrame, keys: list[str], of: str = "log_returns") -> DataFrame:
    s = series(bars, keys, of)
    spread = s.groupBy(*keys).agg((F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"), F.min("x").alias("min"), F.max("x").alias("max"))
    return moments(s, keys).join(spread, keys).withColumn("cohens_d", F.coalesce(F.try_divide("mean", "std"), F.lit(0.0)))


def vol_rolling(bars: DataFrame, keys: list[str], window: int, of: str = "log_returns") -> DataFrame:
    """A row a full window: i (its last value's place), window_start_ms, vol and vol_of_vol (null until a full window of vols)."""
    if window < 2:
        raise ValueError("window is under 2")
    w = over(keys, "i").rowsBetween(-(window - 1), 0)
    s = series(bars, keys, of).select(*keys, "i", F.first("ts_ms").over(w).alias("window_start_ms"), F.stddev_samp("x").over(w).alias("vol")).filter(F.col("i") >= window - 1)
    return s.withColumn("vol_of_vol", F.when(F.col("i") >= 2 * (window - 1), F.stddev_samp("vol").over(w)))


def vol_headline(rolled: DataFrame, keys: list[str]) -> DataFrame:
    last = rolled.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("vol", "i").alias("last_vol"), F.avg("vol").alias("mean_vol"))
    return last.withColumn("vol_ratio", F.when(F.col("mean_vol") > 0, F.try_divide("last_vol", "mean_vol")).otherwise(1.0)).drop("mean_vol")


def ljung_box(bars: DataFrame, keys: list[str], most: int = 10, squared: bool = False, p_values: bool = True) -> DataFrame:
    """A row a lag: lag, acf, q (and p_value). Lags up to least(most, n / 5), each key's own."""
    s = returns(bars, keys)
    if squared:
        s = s.withColumn("x", F.col("x") * F.col("x"))
    c = lags(centred(s, keys).select(*keys, "i", "n", "c"), keys, "c", most)
    sums = c.groupBy(*keys, "n").agg(F.sum(F.col("c") * F.col("c")).alias("s0"), *[F.coalesce(F.sum(F.col("c") * F.col(f"l{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, most + 1)])
    rho = F.array(*[F.coalesce(F.try_divide(f"s{k}", "s0"), F.lit(0.0)) for k in range(1, most + 1)])
    rows = sums.select(*keys, "n", F.posexplode(rho).alias("pos", "acf")).withColumn("lag", F.col("pos") + 1)
    rows = rows.filter(F.col("lag") <= F.least(F.lit(most), F.floor(F.col("n") / 5)))
    n, run = F.col("n").cast("double"), Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = n * (n + 2) * F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag"))).over(run)
    out = rows.select(*keys, "n", F.col("lag").cast("int").alias("lag"), "acf", q.alias("q"))
    return out.withColumn("p_value", dist.chi2_p(F.col("q"), F.col("lag"))) if p_values else out


def jarque_bera(bars: DataFrame, keys: list[str], of: str = "log_returns") -> DataFrame:
    """From the bias-corrected moments; keys with under 4 values or without variance give no row."""
    m = moments(series(bars, keys, of), keys).filter("n >= 4 AND std > 0")
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4)
    m = m.select(*keys, "n", "skew", "excess_kurtosis", jb.alias("jb"))
    return m.withColumn("p_value", F.exp(-F.col("jb") / 2)).withColumn("jb_per_n", F.col("jb") / F.col("n"))


def _scored(bars: DataFrame, keys: list[str], of: str) -> DataFrame:
    """The series with its key's n, median and mad, and each value's z and modified_z. Keys without a MAD give no rows."""
    s = series(bars, keys, of)
    a = s.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.percentile("x", F.lit(0.5)).alias("median"))
    s = s.join(a, keys)
    mad = s.groupBy(*keys).agg(F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)).alias("mad")).filter("mad > 0")
    return s.join(mad, keys).withColumn("z", F.try_divide(F.col("x") - F.col("mean"), "sd")).withColumn("modified_z", F.try_divide(0.6745 * (F.col("x") - F.col("median")), "mad"))


def outliers(bars: DataFrame, keys: list[str], z: float = 3.0, modified_z: float = 3.5, of: str = "log_returns") -> DataFrame:
    """A row a flagged value: i, ts_ms, z, modified_z, with the key's n, median and mad. Keys without a MAD give none."""
    s = _scored(bars, keys, of)
    return s.filter((F.abs("z") > z) | (F.abs("modified_z") > modified_z)).select(*keys, "i", "ts_ms", "n", "median", "mad", "z", "modified_z")


def outlier_profile(bars: DataFrame, keys: list[str], z: float = 3.0, modified_z: float = 3.5, of: str = "log_returns") -> DataFrame:
    """A row a key: n, median, mad, the count of flagged values (which may be 0), its share, and the flagged ones in order."""
    hit = (F.abs("z") > z) | (F.abs("modified_z") > modified_z)
    hit = F.coalesce(hit, F.lit(False))
    flagged = F.array_sort(F.collect_list(F.when(hit, F.struct("i", "ts_ms", "z", "modified_z"))))
    g = _scored(bars, keys, of).groupBy(*keys, "n", "median", "mad").agg(F.sum(hit.cast("long")).alias("count"), flagged.alias("flagged"))
    return g.withColumn("outlier_rate", F.col("count") / F.col("n"))


def drawdown_episodes(bars: DataFrame, keys: list[str], of: str = "log_returns") -> DataFrame:
    """A row an episode: peak, trough and recovery moments, depth (0 or less) and whether it recovered.

    The running peak moves on at equal highs, so an episode is what follows a peak until a value reaches it.
    """
    w = over(keys, "i")
    s = series(bars, keys, of)
    e = s if of == "close" else s.withColumn("x", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("top", F.max("x").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_top", F.col("x") >= F.col("top"))
    e = e.withColumn("peak", F.sum(F.col("is_top").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("next_top_ms", F.min(F.when(F.col("is_top"), F.col("ts_ms"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    below = F.struct((F.col("x") - F.col("top")).alias("d"), F.col("i").alias("i"), F.col("ts_ms").alias("t"))
    g = e.groupBy(*keys, "peak").agg(
        F.count("*").alias("rows"), F.min("i").alias("peak_i"), F.min("ts_ms").alias("peak_ms"), F.min(F.when(~F.col("is_top"), below)).alias("low"),
        F.max_by("next_top_ms", F.col("i")).alias("recovered_ms"),
    )
    return g.filter("rows > 1").select(*keys, "peak_i", "peak_ms", F.col("low.i").alias("trough_i"), F.col("low.t").alias("trough_ms"), F.col("low.d").alias("depth"), "recovered_ms")


def drawdown(bars: DataFrame, keys: list[str], of: str = "log_returns") -> DataFrame:
    e = drawdown_episodes(bars, keys, of)
    closed = F.col("recovered_ms").isNotNull()
    q = lambda p: F.coalesce(F.percentile(F.when(closed, F.col("depth")), F.lit(p)), F.lit(0.0))
    per = e.groupBy(*keys).agg(
        F.min("depth").alias("max_dd"), F.sum(closed.cast("long")).alias("n"), q(0.5).alias("dd_p50"), q(0.95).alias("dd_p95"), q(0.99).alias("dd_p99"),
        F.max(F.when(closed, F.col("trough_ms") - F.col("peak_ms"))).alias("longest_fall_ms"), F.max(F.when(closed, F.col("recovered_ms") - F.col("trough_ms"))).alias("longest_recovery_ms"),
    )
    all_keys = series(bars, keys, of).select(*keys).distinct()
    return all_keys.join(per, keys, "left").fillna({"max_dd": 0.0, "n": 0, "dd_p50": 0.0, "dd_p95": 0.0, "dd_p99": 0.0})


#: Critical values at 10, 5, 2.5 and 1 percent, fixed.
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def _kpss_p(eta: Column, regression: str) -> Column:
    crit, p = KPSS_CRITICAL[regression], (0.10, 0.05, 0.025, 0.01)
    out = F.when(eta <= crit[0], F.lit(0.10))
    for k in range(3):
        out = out.when(eta <= crit[k + 1], p[k] + (eta - crit[k]) / (crit[k + 1] - crit[k]) * (p[k + 1] - p[k]))
    return out.otherwise(0.01)


def kpss(bars: DataFrame, keys: list[str], regression: str = "c", nlags: int | str = "auto") -> DataFrame:
    """n, lag_truncation, eta, p_value; keys whose long-run variance is not positive give no row."""
    s = levels(bars, keys).withColumn("t", F.col("i") + 1.0)
    if regression == "ct":
        fit = s.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("x", "t").alias("b"), F.regr_intercept("x", "t").alias("a"))
        s = s.join(fit, keys).withColumn("e", F.col("x") - F.col("a") - F.col("b") * F.col("t"))
    elif regression == "c":
        s = centred(s, keys).withColumnRenamed("c", "e")
    else:
        raise ValueError(f"unknown regression {regression!r}")
    auto = F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(0.25))).cast("int")
    s = s.select(*keys, "i", "n", "e", (auto if nlags == "auto" else F.lit(int(nlags))).alias("l"))
    longest = s.agg(F.max("l")).first()[0] or 0
    w = over(keys, "i").rowsBetween(Window.unboundedPreceding, 0)
    s = lags(s.withColumn("run", F.sum("e").over(w)), keys, "e", longest, "e")
    terms = [F.when(F.col("l") >= j, 2 * (1 - F.lit(float(j)) / (F.col("l") + 1)) * F.col("e") * F.coalesce(f"e{j}", F.lit(0.0))).otherwise(0.0) for j in range(1, longest + 1)]
    g = s.groupBy(*keys, "n", "l").agg(F.sum(F.col("run") * F.col("run")).alias("ss"), F.sum(sum(terms, F.col("e") * F.col("e"))).alias("lrv_n"))
    g = g.filter("lrv_n > 0").withColumn("eta", F.col("ss") / (F.col("n") * F.col("lrv_n")))
    return g.select(*keys, "n", F.col("l").alias("lag_truncation"), "eta", _kpss_p(F.col("eta"), regression).alias("p_value"))


def variance_ratio(bars: DataFrame, keys: list[str], k_values: tuple[int, ...] = (2, 4, 8, 16), robust: bool = True, p_values: bool = True) -> DataFrame:
    """A row a k (2 <= k <= n / 2): vr, z (and p_value)."""
    if any(k < 2 for k in k_values):
        raise ValueError("k is under 2")
    most = max(k_values)
    s = centred(returns(bars, keys), keys).select(*keys, "i", "n", "c").withColumn("u", F.col("c") * F.col("c"))
    s = lags(s, keys, "u", most - 1, "u")
    w = over(keys, "i")
    s = s.select("*", *[F.when(F.col("i") >= k - 1, F.sum("c").over(w.rowsBetween(-(k - 1), 0))).alias(f"s{k}") for k in k_values])
    g = s.groupBy(*keys, "n").agg(
        F.sum("u").alias("su"), *[F.sum(F.col(f"s{k}") * F.col(f"s{k}")).alias(f"q{k}") for k in k_values], *[F.coalesce(F.sum(F.col("u") * F.col(f"u{j}")), F.lit(0.0)).alias(f"d{j}") for j in range(1, most)],
    )
    n, rows = F.col("n").cast("double"), []
    for k in k_values:
        m = k * (n - k + 1) * (1 - F.lit(float(k)) / n)
        vr = F.try_divide(F.try_divide(f"q{k}", m), F.col("su") / (n - 1))
        var = sum((F.lit((2.0 * (k - j) / k) ** 2) * F.col(f"d{j}") for j in range(1, k)), F.lit(0.0))
        var = F.try_divide(var, F.col("su") * F.col("su")) if robust else 2.0 * (2 * k - 1) * (k - 1) / (3.0 * k * n)
        rows.append(F.when(F.col("n") >= 2 * k, F.struct(F.lit(k).alias("k"), vr.alias("vr"), F.try_divide(vr - 1, F.sqrt(var)).alias("z"))))
    out = g.select(*keys, "n", F.explode(F.array(*rows)).alias("x")).filter("x IS NOT NULL").select(*keys, "n", "x.k", "x.vr", "x.z")
    return out.withColumn("p_value", dist.normal_p(F.col("z"))) if p_values else out


def ou_halflife(bars: DataFrame, keys: list[str], on: str = "level", min_n: int = 30) -> DataFrame:
    """nobs, ar1_coeff, ar1_t_stat, half_life (null: infinite) and lambda."""
    s = levels(bars, keys) if on == "level" else returns(bars, keys)
    p = lags(s, keys, "x", 1).filter("l1 IS NOT NULL").withColumn("d", F.col("x") - F.col("l1"))
    g = p.groupBy(*keys).agg(F.count("*").alias("nobs"), F.regr_slope("d", "l1").alias("rho"), F.regr_intercept("d", "l1").alias("a"), F.regr_sxx("d", "l1").alias("sxx"), F.regr_syy("d", "l1").alias("syy"), F.regr_sxy("d", "l1").alias("sxy"))
    g = g.filter(F.col("nobs") + 1 >= max(3, min_n))
    ssr = F.greatest(F.col("syy") - F.col("rho") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(ssr / (F.col("nobs") - 2), "sxx"))
    half = F.when((F.col("rho") > -1) & (F.col("rho") < 0), -F.lit(float(np.log(2))) / F.log1p("rho"))
    g = g.select(*keys, "nobs", F.col("rho").alias("ar1_coeff"), F.try_divide("rho", se).alias("ar1_t_stat"), half.alias("half_life"))
    return g.withColumn("lambda", F.coalesce(F.lit(float(np.log(2))) / F.col("half_life"), F.lit(0.0)))


def tsmom(bars: DataFrame, keys: list[str], k_values: tuple[int, ...] = (1, 5, 10, 20), scaling: bool = True, vol_window: int = 20, p_values: bool = True) -> DataFrame:
    """A row a horizon k (n >= 4 k): coef, t_stat (p_value), hit_rate, tsmom_mean, turnover and whether it is selected."""
    s = returns(bars, keys)
    if scaling:
        past = over(keys, "i").rowsBetween(-vol_window, -1)
        whole = s.groupBy(*keys).agg(F.stddev_samp("x").alias("all_sd"))
        s = s.select(*keys, "i", "x", F.stddev_samp("x").over(past).alias("sd")).join(whole, keys)
        sd = F.coalesce(F.when(F.col("sd") > 0, F.col("sd")), F.col("all_sd"))
        s = s.withColumn("x", F.coalesce(F.try_divide("x", sd), F.col("x")))
    n = s.groupBy(*keys).agg(F.count("*").alias("n"))
    s = s.select(*keys, "i", "x").join(n, keys).withColumn("k", F.explode(F.array(*[F.lit(k) for k in k_values]))).filter("n >= 4 * k")
    s = s.withColumn("block", F.floor(F.col("i") / F.col("k"))).filter("(block + 1) * k <= n")
    blocks = s.groupBy(*keys, "n", "k", "block").agg(F.sum("x").alias("y"))
    w = Window.partitionBy(*keys, "k").orderBy("block")
    b = blocks.withColumn("x", F.lag("y").over(w)).filter("x IS NOT NULL")
    g = b.groupBy(*keys, "n", "k").agg(
        F.count("*").alias("m"), F.regr_slope("y", "x").alias("coef"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
        F.avg((F.col("x") * F.col("y") > 0).cast("double")).alias("hit_rate"), F.avg(F.signum("x") * F.col("y")).alias("tsmom_mean"),
    )
    ssr = F.greatest(F.col("syy") - F.col("coef") * F.col("sxy"), F.lit(0.0))
    t = F.try_divide("coef", F.sqrt(F.try_divide(F.try_divide(ssr, F.col("m") - 2), "sxx")))
    g = g.select(*keys, "n", "k", "m", "coef", t.alias("t_stat"), "hit_rate", "tsmom_mean", (1.0 / F.col("k")).alias("turnover"))
    rank = Window.partitionBy(*keys).orderBy((F.col("coef") > 0).desc_nulls_last(), F.when(F.col("coef") > 0, F.col("t_stat")).otherwise(F.abs("t_stat")).desc_nulls_last(), "k")
    g = g.withColumn("selected", F.row_number().over(rank) == 1)
    return g.withColumn("p_value", dist.t_p(F.col("t_stat"), F.col("m") - 2)) if p_values else g


def grouped(s: DataFrame, keys: list[str], kernel, fields: str) -> DataFrame:
    """Rows of kernel(x, ts_ms), a list of dicts, for each key's series in order: one task a key, one Arrow transfer."""
    schema = T.StructType([*(s.schema[k] for k in keys), *T._parse_datatype_string(fields).fields])
    names = [f.name for f in schema.fields[len(keys) :]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        rows = kernel(pdf["x"].to_numpy(float), pdf["ts_ms"].to_numpy())
        return pd.DataFrame([[*key, *(r.get(n) for n in names)] for r in rows], columns=[*keys, *names])

    return s.select(*keys, "i", "ts_ms", "x").groupBy(*keys).applyInPandas(run, schema)


def adf(bars: DataFrame, keys: list[str], max_lag: int | None = None, regression: str = "c", autolag: str | None = "AIC") -> DataFrame:
    return grouped(levels(bars, keys), keys, lambda x, _: kernels.adf(x, max_lag, regression, autolag), "nobs long, lag_selected int, tau double, p_value double")


def arch_lm(bars: DataFrame, keys: list[str], lag: int = 5) -> DataFrame:
    return grouped(returns(bars, keys), keys, lambda x, _: kernels.arch_lm(x, lag), "nobs long, lm double, p_value double, f_statistic double, f_p_value double")


def cusum_break(bars: DataFrame, keys: list[str], target: str = "both", threshold: float = 1.358, min_segment: int = 30) -> DataFrame:
    """A row a break, ordered by break_index and target; keys without a break give none."""
    fields = "target string, break_index long, break_ts_ms long, statistic double, regime_index int, pre_n long, post_n long, pre_mean double, post_mean double, pre_std double, post_std double, pre_median double, post_median double"
    return grouped(returns(bars, keys), keys, lambda x, t: kernels.cusum_breaks(x, t, target, threshold, min_segment), fields)
