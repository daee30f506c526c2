"""Runs scan requests: preflight, gaps, resampling, the scan, hygiene, and findings as rows.

All single-instrument jobs of one scan, timeframe, window, policy and parameters run as one plan over all their
instruments; pairs and resampled jobs have plans of their own. A stretch for which a scan has no result, an instrument
without bars, and parameters that a scan refuses give a scan_error and not an end of the sweep.
"""

from __future__ import annotations

import itertools
import tomllib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import indexed, series
from tickloom.model import GAP_POLICIES, Invalid, ScanRequest, check_aligned, instrument, param_hash, step_of, window
from tickloom.operators import bars as bar_ops
from tickloom.operators import cross, gaps, hygiene
from tickloom.plans.registry import Scan, scan_of

KEYS = ["symbol", "side"]
FINDING = "kind string, job string, scan string, instruments string, segment int, start_ms long, end_ms long, param_hash string, metric string, value double, p_value double, n long, ci_low double, ci_high double, extra string, error string"


def preflight(r: ScanRequest) -> tuple[Scan, dict, list[tuple[str, str]]]:
    scan = scan_of(r.scan)
    who = [instrument(i) for i in r.instruments]
    if len(who) != scan.arity:
        raise Invalid("wrong_instrument_arity", f"{r.scan} takes {scan.arity} instruments, not {len(who)}")
    step_of(r.timeframe)
    check_aligned(r.window[0], r.timeframe)
    if r.gap_policy not in GAP_POLICIES:
        raise Invalid("invalid_parameter", f"unknown gap policy {r.gap_policy!r}")
    if (r.bootstrap and hygiene_kind("bootstrap", scan) is None) or (r.null and hygiene_kind(r.null, scan) is None):
        raise Invalid("hygiene_not_supported", f"{r.scan} does not support {r.bootstrap or r.null}")
    hygiene.resamples(r.bootstrap_n), hygiene.resamples(r.null_n)
    return scan, scan.resolve(r.params), who


def hygiene_kind(kind: str, scan: Scan) -> str | None:
    return kind if kind in scan.hygiene and (scan.arity == 2 or scan.id in hygiene.STATISTICS) else None


def _of(minute_bars: DataFrame, who: list[tuple[str, str]]) -> DataFrame:
    cond = F.lit(False)
    for symbol, side in who:
        cond = cond | ((F.col("symbol") == symbol) & (F.col("side") == side))
    return minute_bars.filter(cond)


def prepared(minute_bars: DataFrame, r: ScanRequest, who: list[tuple[str, str]], pair: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Bars (or pairs) of the gap-free stretches with their segment, the refused instruments, and the key columns."""
    spark = minute_bars.sparkSession
    start, end = r.window
    own = _of(minute_bars, who)
    listed = spark.createDataFrame(who, "symbol string, side string")
    found = gaps.detect(own, KEYS, start, end, instruments=listed)
    keys = KEYS
    if pair:
        found = gaps.of_pair(found.withColumn("leg", F.concat_ws(":", *KEYS)).select(F.lit("pair").alias("pair"), "leg", "start_ms", "end_ms", "reason"), ["pair", "leg"], "leg")
        listed, keys = spark.createDataFrame([("pair",)], "pair string"), ["pair"]
    found = gaps.effective(found, keys, r.timeframe)
    refused = gaps.aborted(found, keys, start, end)
    coarse = bar_ops.resample(bar_ops.within(own, start, end), r.timeframe, KEYS).drop("ts_close_ms")
    if pair:
        legs = coarse.withColumn("leg", F.concat_ws(":", *KEYS)).withColumn("pair", F.lit("pair"))
        coarse = bar_ops.aligned(legs, ["pair", "leg"], "leg", *[":".join(w) for w in who])
    if r.gap_policy == "strict":
        return coarse.join(refused, keys, "left_anti").withColumn("segment", F.lit(1)), refused, keys
    parts = gaps.segments(found, keys, listed, start, end, r.timeframe)
    out = gaps.segmented(coarse, keys, parts)
    if r.scan.startswith("cross.cointegration.engle_granger"):
        out = out.withColumn("segment", F.lit(1))  # the one scan that takes its stretches together
    return out, refused.limit(0), keys


def run(minute_bars: DataFrame, r: ScanRequest) -> DataFrame:
    """Findings of one request: a result for each stretch, gap_aborted, or scan_error. Bars: symbol, side, ts_ms, open .. tick_volume."""
    return run_together(minute_bars, [r])


def run_together(minute_bars: DataFrame, jobs: list[ScanRequest]) -> DataFrame:
    """Findings of requests that differ in their instruments only, as one plan. Pairs and resampling run one request at a time."""
    r = jobs[0]
    scan, params, who = preflight(r)
    for other in jobs[1:]:
        who = who + preflight(other)[2]
    spark, pair = minute_bars.sparkSession, scan.arity == 2
    if len(jobs) > 1 and (pair or r.bootstrap or r.null):
        raise ValueError("only single instruments without resampling run together")
    base = {"scan": r.scan, "param_hash": param_hash(params)}
    named = spark.createDataFrame([(*(("pair",) if pair else w), str(j.job_seed()), ",".join(j.instruments)) for j, w in zip(jobs, who, strict=False)], ("pair string" if pair else "symbol string, side string") + ", job string, instruments string")
    tag = [F.lit(v).alias(k) for k, v in base.items()]
    if r.dry_run:
        return named.select(F.lit("dry_run").alias("kind"), "job", "instruments", *tag)
    data, refused, own = prepared(minute_bars, r, who, pair)
    keys = [*own, "segment"]
    given = scan.arguments(params)
    if "timeframe" in scan.params:
        given["timeframe"] = r.timeframe
    try:
        rows = scan.run(data, keys, **given)
    except ValueError as e:
        return named.select(F.lit("scan_error").alias("kind"), "job", "instruments", *tag, F.lit(f"compute_error: {e}").alias("error"))
    head = scan.head(rows, keys) if scan.head else rows
    metric = F.col(scan.value).cast("double")
    spans = data.groupBy(*keys).agg(F.min("ts_ms").alias("start_ms"), (F.max("ts_ms") + step_of(r.timeframe)).alias("end_ms"))
    # one row a result, a stretch without one, an instrument without bars, and a refused instrument
    out = named.join(spans, own, "left").join(refused.select(*own, "n_gaps"), own, "left").join(head.withColumn("found", F.lit(True)), keys, "left")
    p = F.col(scan.p) if scan.p else F.lit(None).cast("double")
    low = high = F.lit(None).cast("double")
    if r.bootstrap or r.null:
        cols, stat, tail = hygiene.statistic(scan.id, given)
        if not pair:
            s, cols = series(data, keys, *cols), ("x",)
        else:
            s = cross.pair_returns(data, keys) if cols == ("ra", "rb") else indexed(data, keys)
        if r.bootstrap:
            ci = hygiene.bootstrap_ci(s, keys, stat, r.bootstrap_n, r.bootstrap, r.job_seed(), cols=cols).drop("observed")
            out, low, high = out.join(ci, keys, "left"), F.col("lo"), F.col("hi")
        if r.null:
            null = hygiene.null_p(s, keys, stat, tail, r.null_n, r.null, r.job_seed(), cols=cols).select(*keys, F.col("p_value").alias("null_p"))
            out, p = out.join(null, keys, "left"), F.coalesce("null_p", p)
    extra = F.to_json(F.struct(*[c for c in head.columns if c not in keys]))
    n = F.col(scan.n).cast("long") if scan.n and scan.n in head.columns else F.lit(None).cast("long")
    found, refuse, bare = F.col("found").isNotNull(), F.col("n_gaps").isNotNull(), F.col("segment").isNull()
    empty = F.lit(scan.empty is not None) & ~found
    kind = F.when(refuse, "gap_aborted").when(bare, "scan_error").when(found | empty, "result").otherwise("scan_error")
    error = F.when(refuse | found, None).when(bare, "coverage_gap: no bars in the window").when(~empty, "compute_error: too few values, or all alike")
    return out.select(
        kind.alias("kind"), "job", "instruments", *tag, F.col("segment").cast("int").alias("segment"), "start_ms", "end_ms", F.when(~bare, F.lit(scan.value)).alias("metric"),
        F.when(found, metric).when(empty & ~bare, F.lit(scan.empty).cast("double")).alias("value"), p.alias("p_value"), F.when(refuse, F.col("n_gaps").cast("long")).otherwise(n).alias("n"),
        low.alias("ci_low"), high.alias("ci_high"), F.when(found, extra).alias("extra"), error.alias("error"),
    )


@dataclass(frozen=True)
class Sweep:
    jobs: list[ScanRequest]
    family: str = "scan_id"
    alpha: float = 0.05
    extra: dict = field(default_factory=dict)


def _grid(params: dict) -> list[dict]:
    """Every choice of one value for each listed parameter. A list of lists gives list values."""
    names = sorted(params)
    choices = [params[k] if isinstance(params[k], list) else [params[k]] for k in names]
    size = 1
    for c in choices:
        size *= len(c)
    if size > 10_000_000:
        raise Invalid("sweep_too_large", f"{size} parameter choices")
    return [dict(zip(names, c, strict=True)) for c in itertools.product(*choices)]


def parse_sweep(text: str, seed: int | None = None, bootstrap: str | None = None, bootstrap_n: int | None = None, null: str | None = None, null_n: int | None = None) -> Sweep:
    """A sweep manifest (TOML); arguments replace its global values."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise Invalid("invalid_config", str(e)) from e
    head, hyg, fdr = doc.get("sweep", {}), doc.get("hygiene", {}), doc.get("fdr", {})
    hyg = hyg | {k: v for k, v in (("bootstrap", bootstrap), ("null", null)) if v} | {k: v for k, v in (("bootstrap_n", bootstrap_n), ("null_n", null_n)) if v}
    jobs = []
    for j in doc.get("jobs", []):
        scan = scan_of(j["scan"])
        own = hyg | j.get("hygiene", {})
        for who, tf, win, params in itertools.product(j["instruments"], j["timeframes"], j["windows"], _grid(j.get("params", {}))):
            names = tuple(who) if isinstance(who, list) else (who,)
            one = ScanRequest(
                scan.name, names, tf, window(win), j.get("gap_policy", "continuous_only"), params, own.get("bootstrap"), own.get("bootstrap_n", 1000), own.get("null"), own.get("null_n", 1000), seed if seed is not None else head.get("seed", 0),
            )
            preflight(one)
            jobs.append(one)
    if len(jobs) > head.get("max_jobs", 100_000):
        raise Invalid("sweep_too_large", f"{len(jobs)} jobs, at most {head.get('max_jobs', 100_000)}")
    return Sweep(jobs, fdr.get("family", "scan_id"), fdr.get("alpha", 0.05))


def together(jobs: list[ScanRequest]) -> list[list[ScanRequest]]:
    """Jobs that can share a plan: one scan, timeframe, window, policy and parameters, one instrument each, not resampled."""
    out: dict = {}
    for i, j in enumerate(jobs):
        alone = len(j.instruments) != 1 or j.bootstrap or j.null
        key = i if alone else (j.scan, j.timeframe, j.window, j.gap_policy, param_hash(j.params), j.dry_run)
        while not alone and j.instruments in {o.instruments for o in out.get(key, ())}:  # a job given twice
            key = (*key, "again")
        out.setdefault(key, []).append(j)
    return list(out.values())


def run_sweep(minute_bars: DataFrame, sweep: Sweep) -> DataFrame:
    """All jobs' findings, with fdr_q within each family."""
    parts = [run_together(minute_bars, jobs) for jobs in together(sweep.jobs)]
    if not parts:
        return minute_bars.sparkSession.createDataFrame([], FINDING + ", fdr_q double")
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    family = hygiene.family_of(F.col("scan"), sweep.family)
    if family is None:
        return out.withColumn("fdr_q", F.lit(None).cast("double"))
    return hygiene.fdr(out.withColumn("family", family)).drop("family")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by scan and outcome."""
    return findings.groupBy("scan").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ("result", "gap_aborted", "scan_error")], F.count("p_value").alias("n_with_p"))


def run_id() -> str:
    """26 characters of Crockford's base 32, as in a ULID."""
    x, out = uuid.uuid4().int, ""
    for _ in range(26):
        out = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"[x & 31] + out
        x >>= 5
    return out
