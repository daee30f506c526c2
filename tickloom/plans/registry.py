"""The catalogue of scans: id@version, arity, parameters with defaults, emitted fields and hygiene support."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tickloom.model import Invalid, step_of
from tickloom.operators import anom, cross, seas


@dataclass(frozen=True)
class Scan:
    id: str
    arity: int  # instruments: 1 or 2
    run: Callable[..., DataFrame]  # (bars or pairs, keys, **params)
    value: str  # the headline column of `head`
    head: Callable[[DataFrame, list[str]], DataFrame] | None = None  # rows to one row a key; None: the rows are the findings
    p: str | None = None
    n: str | None = "n"
    hygiene: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    version: int = 1
    names: dict = field(default_factory=dict)  # parameter -> argument of run, where they differ
    empty: float | None = None  # the value of a stretch in which there is nothing to find; None: that is an error
    choices: dict = field(default_factory=dict)  # parameters that change nothing: their values, the default first (empty: any)

    @property
    def name(self) -> str:
        return f"{self.id}@{self.version}"

    @property
    def params(self) -> dict:
        """Parameter names with their defaults; None for those that must be given."""
        public = {v: k for k, v in self.names.items()}
        own = {public.get(k, k): (None if p.default is inspect.Parameter.empty else p.default) for k, p in list(inspect.signature(self.run).parameters.items())[2:] if k not in ("p_values", "step_ms")}
        return own | {k: (v[0] if v else None) for k, v in self.choices.items()}

    def resolve(self, given: dict) -> dict:
        """Given parameters, by their own names or those of the arguments, over the defaults."""
        public = {v: k for k, v in self.names.items()}
        given = {public.get(k, k): v for k, v in given.items()}
        if unknown := sorted(set(given) - set(self.params)):
            raise Invalid("invalid_parameter", f"{self.name} has no parameter {', '.join(unknown)}")
        if missing := [k for k in self.required if given.get(k) is None]:
            raise Invalid("invalid_parameter", f"{self.name} needs {', '.join(missing)}")
        if wrong := [k for k, v in self.choices.items() if v and given.get(k, v[0]) not in v]:
            raise Invalid("invalid_parameter", f"{self.name}: no such {', '.join(wrong)}")
        return {k: v for k, v in (self.params | given).items() if v is not None or k in given}

    def arguments(self, params: dict) -> dict:
        """Resolved parameters as arguments of run."""
        return {self.names.get(k, k): tuple(v) if isinstance(v, list) and k.endswith("values") else v for k, v in params.items() if k not in self.choices}


def _last(value: str, order: str):
    def head(rows: DataFrame, keys: list[str]) -> DataFrame:
        from pyspark.sql import functions as F

        return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("h"), F.count("*").alias("rows")).select(*keys, "h.*", "rows")

    return head


def _only(flag: str):
    return lambda rows, keys: rows.filter(flag)


SERIES, LAGS = {"series": "of"}, {"lags": "most"}
REGRESSION = {"regression": ("c", "ct")}
B, C, P = "bootstrap", "circular_shift", "phase_scramble"


def ljung_box(bars: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    return anom.ljung_box(bars, keys, most)


def ljung_box_sq(bars: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    return anom.ljung_box(bars, keys, most, True)


def hour_of_day(bars: DataFrame, keys: list[str], min_obs_per_bucket: int = 5) -> DataFrame:
    return seas.bucket_scan(bars, keys, "hour_of_day", min_obs_per_bucket)


def day_of_week(bars: DataFrame, keys: list[str], min_obs_per_bucket: int = 5) -> DataFrame:
    return seas.bucket_scan(bars, keys, "day_of_week", min_obs_per_bucket)


def session(bars: DataFrame, keys: list[str], sessions: list | None = None, min_obs_per_bucket: int = 5) -> DataFrame:
    if sessions is not None and not 0 < len(sessions) <= 100:
        raise Invalid("invalid_parameter", "between 1 and 100 sessions")
    own = tuple((s["name"], s["start_utc_hour"], s["end_utc_hour"]) for s in sessions) if sessions else seas.SESSIONS
    return seas.bucket_scan(bars, keys, "session", min_obs_per_bucket, sessions=own)


def eom_som(bars: DataFrame, keys: list[str], cutoff_n: int = 3, min_obs_per_bucket: int = 5) -> DataFrame:
    return seas.bucket_scan(bars, keys, "eom_som", min_obs_per_bucket, cutoff=cutoff_n)


def anova(bars: DataFrame, keys: list[str], buckets_via: str, min_obs_per_group: int = 5) -> DataFrame:
    return seas.anova_kruskal(bars, keys, buckets_via, min_obs_per_group)


def pre_post(bars: DataFrame, keys: list[str], event_timestamps: list[int], pre_window_bars: int = 5, post_window_bars: int = 5) -> DataFrame:
    if not event_timestamps or len(event_timestamps) > 100_000:
        raise Invalid("invalid_parameter", "between 1 and 100000 events")
    events = bars.sparkSession.createDataFrame([(int(e),) for e in event_timestamps], "event_ms long")
    return seas.event_window(bars, keys, events, pre_window_bars, post_window_bars)


def _pre_post_head(rows: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import functions as F

    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("post_mean").alias("post_mean"), (F.avg("post_mean") - F.avg("pre_mean")).alias("post_minus_pre"))


def overnight(bars: DataFrame, keys: list[str], boundary_gap_minutes: int | None = None, size_bucket_edges: list | None = None, min_gap_threshold: float = 0.0, fill_lookahead_bars: int = 48, timeframe: str = "15m") -> DataFrame:
    edges = tuple(size_bucket_edges or (0.0005, 0.001, 0.002))
    if len(edges) > 64 or list(edges) != sorted(edges):
        raise Invalid("invalid_parameter", "at most 64 ascending edges")
    return seas.overnight_gaps(bars, keys, step_of(timeframe), boundary_gap_minutes, edges, min_gap_threshold, fill_lookahead_bars)


SCANS: dict[str, Scan] = {
    s.name: s
    for s in (
        Scan("stats.returns.profile", 1, anom.returns_profile, "mean", fields=("n", "mean", "std")),
        Scan("stats.summary.welford", 1, anom.summary, "mean", hygiene=(B,), fields=("n", "std", "skew", "excess_kurtosis", "iqr", "min", "max", "cohens_d"), names=SERIES),
        Scan("stats.vol.rolling", 1, anom.vol_rolling, "last_vol", anom.vol_headline, hygiene=(B,), required=("window",), fields=("vol", "vol_of_vol", "window_start_ms"), choices={"min_periods": ()}, names=SERIES),
        Scan("stats.autocorr.ljung_box", 1, ljung_box, "q", _last("q", "lag"), "p_value", hygiene=(B, C, P), fields=("lag", "acf", "q", "p_value"), names=LAGS),
        Scan("stats.autocorr.ljung_box_sq", 1, ljung_box_sq, "q", _last("q", "lag"), "p_value", hygiene=(B, C, P), fields=("lag", "acf", "q", "p_value"), names=LAGS),
        Scan("stats.stationarity.adf", 1, anom.adf, "tau", p="p_value", n="nobs", hygiene=(B, C, P), fields=("nobs", "lag_selected", "tau", "p_value")),
        Scan("stats.stationarity.kpss", 1, anom.kpss, "eta", p="p_value", hygiene=(B, C, P), fields=("lag_truncation", "eta", "p_value")),
        Scan("stats.variance_ratio.lo_mackinlay", 1, anom.variance_ratio, "vr", _last("vr", "k"), hygiene=(B, C, P), fields=("k", "vr", "z", "p_value")),
        Scan("stats.heteroskedasticity.arch_lm", 1, anom.arch_lm, "lm", p="p_value", n="nobs", hygiene=(B, C, P), fields=("lm", "p_value", "f_statistic", "f_p_value")),
        Scan("stats.normality.jarque_bera", 1, anom.jarque_bera, "jb", p="p_value", hygiene=(B,), fields=("skew", "excess_kurtosis", "jb", "p_value"), names=SERIES),
        Scan("stats.outliers.z_and_mad", 1, anom.outlier_profile, "count", fields=("n", "median", "mad", "count", "outlier_rate", "flagged"), names=SERIES | {"z_threshold": "z", "modified_z_threshold": "modified_z"}),
        Scan("stats.drawdown.profile", 1, anom.drawdown, "max_dd", fields=("max_dd", "dd_p50", "dd_p95", "dd_p99"), names=SERIES),
        Scan("stats.regime.cusum_break", 1, anom.cusum_break, "statistic", n=None, fields=("target", "break_index", "break_ts_ms", "regime_index", "pre_mean", "post_mean", "pre_std", "post_std")),
        Scan("stats.meanrev.ou_halflife", 1, anom.ou_halflife, "lambda", n="nobs", fields=("ar1_coeff", "ar1_t_stat", "half_life")),
        Scan("stats.momentum.tsmom", 1, anom.tsmom, "coef", _only("selected"), "p_value", fields=("k", "coef", "t_stat", "p_value", "hit_rate", "tsmom_mean", "turnover")),
        Scan("cross.corr.pearson_rolling", 2, cross.pearson_rolling, "r", _last("r", "i"), n="rows", required=("window",), hygiene=(B, C), fields=("i", "window_start_ms", "r", "crossing")),
        Scan("cross.corr.spearman_rolling", 2, cross.spearman_rolling, "rho", _last("rho", "i"), n="rows", required=("window",), hygiene=(B, C), fields=("i", "window_start_ms", "rho", "crossing")),
        Scan("cross.ols.rolling", 2, cross.ols_rolling, "beta", _last("beta", "i"), n="rows", required=("window",), hygiene=(B, C), fields=("beta", "alpha", "r2", "residual_std")),
        Scan("cross.lead_lag.ccf", 2, cross.lead_lag, "lag", _only("best"), hygiene=(B, C, P), fields=("lag", "ccf", "best")),
        Scan("cross.cointegration.engle_granger", 2, cross.engle_granger, "hedge_ratio", p="adf_p", hygiene=(B, C, P), fields=("hedge_ratio", "alpha", "adf_stat", "adf_p", "ou_half_life", "residual_std"), names={"min_aligned_n": "least"}, choices=REGRESSION),
        Scan("cross.cointegration.rolling", 2, cross.cointegration_rolling, "hedge_ratio", p="adf_p", required=("window",), fields=("window_index", "window_start_ms", "window_end_ms", "reason_code"), names={"adf_p_enter": "enter", "adf_p_exit": "leave", "beta_band": "band", "min_aligned_n": "least"}, choices=REGRESSION),
        Scan("seas.bucket.hour_of_day", 1, hour_of_day, "max_abs_t", seas.max_abs_t, fields=("bucket", "count", "mean", "std", "t_stat", "iqr")),
        Scan("seas.bucket.day_of_week", 1, day_of_week, "max_abs_t", seas.max_abs_t, fields=("bucket", "count", "mean", "std", "t_stat", "iqr")),
        Scan("seas.bucket.session", 1, session, "max_abs_t", seas.max_abs_t, fields=("bucket", "count", "mean", "std", "t_stat", "iqr")),
        Scan("seas.bucket.eom_som", 1, eom_som, "max_abs_t", seas.max_abs_t, fields=("bucket", "count", "mean", "std", "t_stat", "iqr")),
        Scan("seas.test.anova_kruskal", 1, anova, "f_stat", p="anova_p", required=("buckets_via",), fields=("k", "f_stat", "kw_stat", "omega_squared", "anova_p", "kw_p")),
        Scan("seas.event.pre_post_window", 1, pre_post, "post_mean", _pre_post_head, required=("event_timestamps",), fields=("event_ms", "pre_mean", "pre_std", "post_mean", "post_std"), empty=0.0),
        Scan("seas.gap.overnight", 1, overnight, "fill_rate", seas.gap_headline, fields=("size", "direction", "bucket", "bars_to_fill"), choices={"resolution_hint": ()}, empty=0.0),
    )
}


def scan_of(name: str) -> Scan:
    if name not in SCANS:
        raise Invalid("unknown_scan", f"unknown scan {name!r}")
    return SCANS[name]


def catalogue() -> list[dict]:
    return [{"scan_id": s.id, "version": s.version, "arity": s.arity, "params": s.params, "required": list(s.required), "finding_fields": list(s.fields), "hygiene": list(s.hygiene)} for _, s in sorted(SCANS.items())]
