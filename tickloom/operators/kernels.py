"""Numpy kernels over one key's whole series, for what needs matrix solves or recursion."""

from __future__ import annotations

import math

import numpy as np

from tickloom.functions import dist

#: Critical values at 1, 5 and 10 percent, fixed.
ADF_CRITICAL = {"nc": (-2.567, -1.941, -1.616), "c": (-3.43, -2.861, -2.567), "ct": (-3.96, -3.41, -3.12), "ctt": (-4.37, -3.83, -3.55)}


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Coefficients, residual sum of squares and the inverse of x'x; None if x'x is singular."""
    try:
        inverse = np.linalg.inv(x.T @ x)
    except np.linalg.LinAlgError:
        return None
    beta = inverse @ (x.T @ y)
    return beta, float(((y - x @ beta) ** 2).sum()), inverse


def _adf_fit(y: np.ndarray, k: int, regression: str) -> tuple[float, float, int, int] | None:
    """tau, SSR, observations and regressors with k lagged differences."""
    d, n = np.diff(y), len(y) - 1 - k
    t = np.arange(k + 1, len(y), dtype=float)
    parts = [[], [np.ones(n)], [np.ones(n), t], [np.ones(n), t, t * t]][("nc", "c", "ct", "ctt").index(regression)]
    cols = [*parts, y[k:-1], *[d[k - j : len(d) - j] for j in range(1, k + 1)]]
    if n <= len(cols):
        return None
    x = np.stack(cols, axis=1)
    if (fit := ols(x, d[k:])) is None:
        return None
    beta, ssr, inverse = fit
    at = len(parts)
    var = ssr / (n - len(cols)) * inverse[at, at]
    return (float(beta[at] / math.sqrt(var)), ssr, n, len(cols)) if var > 0 else None


def adf_p(tau: float, regression: str) -> float:
    """Piecewise between the critical values."""
    c1, c5, c10 = ADF_CRITICAL[regression]
    if tau <= c1:
        return min(0.01, max(0.0, 0.02 * (1 - float(dist.normal_sf(tau - c1)))))
    if tau <= c5:
        return 0.01 + (tau - c1) / (c5 - c1) * 0.04
    if tau <= c10:
        return 0.05 + (tau - c5) / (c10 - c5) * 0.05
    return 1.0 if tau >= 0 else 0.10 + (tau - c10) / -c10 * 0.90


def adf(y: np.ndarray, max_lag: int | None = None, regression: str = "c", autolag: str | None = "AIC") -> list[dict]:
    n = len(y)
    if n < 4:
        return []
    most = math.floor(12 * (n / 100) ** 0.25) if max_lag is None else max_lag
    most = min(most, n - 3)
    best = most
    if autolag in ("AIC", "BIC"):
        least, best = math.inf, None
        for k in range(most + 1):  # each lag on its own sample; ties keep the smaller
            fit = _adf_fit(y, k, regression)
            if fit and fit[1] > 0:
                info = fit[2] * math.log(fit[1] / fit[2]) + fit[3] * (2 if autolag == "AIC" else math.log(fit[2]))
                if info < least:
                    least, best = info, k
    fit = _adf_fit(y, best, regression) if best is not None else None
    return [{"nobs": fit[2], "lag_selected": best, "tau": fit[0], "p_value": adf_p(fit[0], regression)}] if fit else []


def arch_lm(r: np.ndarray, lag: int = 5) -> list[dict]:
    n = len(r)
    if not 1 <= lag <= n / 3 or n < 2 * lag + 2:
        return []
    u = (r - r.mean()) ** 2
    y, m = u[lag:], n - lag
    sst = float(((y - y.mean()) ** 2).sum())
    fit = ols(np.stack([np.ones(m), *[u[lag - j : n - j] for j in range(1, lag + 1)]], axis=1), y) if sst > 0 else None
    if fit is None:
        return [{"nobs": m, "lm": 0.0, "p_value": 1.0, "f_statistic": 0.0, "f_p_value": 1.0}]
    r2 = min(1.0, max(0.0, 1 - fit[1] / sst))
    lm, d2 = m * r2, n - 2 * lag - 1
    f = r2 / (1 - r2) * d2 / lag if r2 < 1 and d2 > 0 else math.nan
    return [{"nobs": m, "lm": lm, "p_value": dist.chi2_sf(lm, lag), "f_statistic": f, "f_p_value": dist.f_sf(f, lag, d2)}]


def _cusum(x: np.ndarray, kind: str) -> tuple[float, int] | None:
    """The statistic and the place of its first maximum."""
    n, s = len(x), float(x.std(ddof=1))
    if s <= 1e-12:
        return None
    if kind == "mean":
        path = np.abs(np.cumsum(x - x.mean())) / (s * math.sqrt(n))
    else:
        c = np.cumsum((x - x.mean()) ** 2)
        path = math.sqrt(n / 2) * np.abs(c / c[-1] - np.arange(1, n + 1) / n)
    k = int(path[:-1].argmax())
    return float(path[k]), k


def _segment(x: np.ndarray, at: int, kind: str, threshold: float, least: int) -> list[tuple[int, float]]:
    """Breaks (index of the last value before, statistic) in x, which starts at `at`."""
    if len(x) < 2 * least or (hit := _cusum(x, kind)) is None:
        return []
    stat, k = hit
    if stat <= threshold or k + 1 < least or len(x) - k - 1 < least:
        return []
    return [*_segment(x[: k + 1], at, kind, threshold, least), (at + k, stat), *_segment(x[k + 1 :], at + k + 1, kind, threshold, least)]


def cusum_breaks(x: np.ndarray, ts: np.ndarray, target: str = "both", threshold: float = 1.358, least: int = 30) -> list[dict]:
    if target not in ("mean", "vol", "both"):
        raise ValueError(f"unknown target {target!r}")
    out = []
    for kind in ("mean", "vol") if target == "both" else (target,):
        found = _segment(x, 0, kind, threshold, max(2, least))
        edges = [0, *[k + 1 for k, _ in found], len(x)]
        for j, (k, stat) in enumerate(found):
            pre, post = x[edges[j] : k + 1], x[k + 1 : edges[j + 2]]
            row = {"target": kind, "break_index": k, "break_ts_ms": int(ts[k + 1]), "statistic": stat, "regime_index": j}
            for name, part in (("pre", pre), ("post", post)):
                row |= {f"{name}_n": len(part), f"{name}_mean": float(part.mean()), f"{name}_std": float(part.std(ddof=1)), f"{name}_median": float(np.median(part))}
            out.append(row)
    return sorted(out, key=lambda r: (r["break_index"], r["target"]))
