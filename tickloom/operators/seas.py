"""Seasonality scans. Returns are keyed by the later bar; each scan gives a row a bucket, event or gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import dist
from tickloom.functions.calendar import month_edge_days
from tickloom.functions.series import date_of, day_of, hour_of, indexed, over, returns, weekday_of
from tickloom.model import HOUR

#: (name, first hour, hour after the last), UTC; a session may go over midnight.
SESSIONS = (("asia", 22, 7), ("london", 7, 16), ("ny", 12, 21), ("overlap", 12, 16))


def bucket_stats(s: DataFrame, keys: list[str], buckets: list, least: int = 5) -> DataFrame:
    """For (keys, bucket, x): a row for every bucket of every key with count, mean, std, t_stat and iqr; all but the count
    are null under `least` (2 at least) values, t_stat also without variance."""
    spark = s.sparkSession
    kind = s.schema["bucket"].dataType
    dense = s.select(*keys).distinct().withColumn("bucket", F.explode(F.array(*[F.lit(b).cast(kind) for b in buckets])))
    g = s.filter("bucket IS NOT NULL").groupBy(*keys, "bucket").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"),
    )
    assert spark is not None
    g = dense.join(g, [*keys, "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    enough = F.col("count") >= max(least, 2)
    t = F.try_divide(F.col("mean"), F.col("std") / F.sqrt(F.col("count")))
    return g.select(*keys, "bucket", "count", *[F.when(enough, c).alias(n) for n, c in (("mean", F.col("mean")), ("std", F.col("std")), ("t_stat", t), ("iqr", F.col("iqr")))])


def max_abs_t(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.groupBy(*keys).agg(F.sum("count").alias("n"), F.coalesce(F.max(F.abs("t_stat")), F.lit(0.0)).alias("max_abs_t"))


def in_session(hour: Column, first: int, after: int) -> Column:
    return (hour >= first) & (hour < after) if first <= after else (hour >= first) | (hour < after)


def bucketed(bars: DataFrame, keys: list[str], by: str, sessions=SESSIONS, cutoff: int = 3) -> tuple[DataFrame, list]:
    """(keys, bucket, x) and the buckets in order; a return is in every session that holds its hour."""
    s = returns(bars, keys)
    if by == "hour_of_day":
        return s.withColumn("bucket", hour_of(F.col("ts_ms"))), list(range(24))
    if by == "day_of_week":
        return s.withColumn("bucket", weekday_of(F.col("ts_ms"))), list(range(7))
    if by == "session":
        names = F.array_compact(F.array(*[F.when(in_session(hour_of(F.col("ts_ms")), a, b), F.lit(n)) for n, a, b in sessions]))
        return s.withColumn("bucket", F.explode(names)), [n for n, _, _ in sessions]
    if by == "eom_som":
        if not 1 <= cutoff <= 10:
            raise ValueError("cutoff is not within 1 to 10")
        days = month_edge_days(s.select(F.min(day_of(F.col("ts_ms"))).alias("a"), F.max(day_of(F.col("ts_ms"))).alias("b")), cutoff)
        labels = [f"EOM-{k}" for k in range(cutoff, 0, -1)] + [f"SOM-{k}" for k in range(1, cutoff + 1)]
        return s.withColumn("day", day_of(F.col("ts_ms"))).join(days, "day", "left"), labels
    raise ValueError(f"unknown buckets {by!r}")


def bucket_scan(bars: DataFrame, keys: list[str], by: str, least: int = 5, **kw) -> DataFrame:
    s, buckets = bucketed(bars, keys, by, **kw)
    return bucket_stats(s.select(*keys, "bucket", "x"), keys, buckets, least)


def anova_kruskal(bars: DataFrame, keys: list[str], by: str = "hour_of_day", least: int = 5, p_values: bool = True) -> DataFrame:
    """f_stat and kw_stat over groups of at least `least` values (two groups at least), with omega_squared."""
    s, _ = bucketed(bars, keys, by)
    s = s.filter("bucket IS NOT NULL").select(*keys, F.col("bucket").cast("string").alias("bucket"), "x")
    big = s.groupBy(*keys, "bucket").agg(F.count("*").alias("m"), F.avg("x").alias("gm")).filter(F.col("m") >= least)
    s = s.join(big, [*keys, "bucket"])
    g = s.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("k"), F.avg("x").alias("mean"), F.sum((F.col("x") - F.col("gm")) * (F.col("x") - F.col("gm"))).alias("ssw")).filter("k >= 2")
    between = big.join(g.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(F.col("m") * (F.col("gm") - F.col("mean")) * (F.col("gm") - F.col("mean"))).alias("ssb"))
    # ranks over distinct values: how many rows lie below each
    ties = s.groupBy(*keys, "x").agg(F.count("*").alias("c"))
    below = F.coalesce(F.sum("c").over(over(keys, "x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ties.select(*keys, "x", "c", (below + (F.col("c") + 1) / 2).alias("rank"))
    sums = s.join(ranks, [*keys, "x"]).groupBy(*keys, "bucket", "m").agg(F.sum("rank").alias("rs"))
    sums = sums.groupBy(*keys).agg(F.sum(F.col("rs") * F.col("rs") / F.col("m")).alias("rr"))
    tie = ranks.groupBy(*keys).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double").alias("tie"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1), 1 - F.col("tie") / (n * n * n - n))
    f = F.try_divide(F.col("ssb") / (k - 1), F.try_divide(F.col("ssw"), n - k))
    out = g.join(between, keys).join(sums, keys).join(tie, keys).select(*keys, "n", "k", f.alias("f_stat"), h.alias("kw_stat"))
    top = (F.col("k") - 1) * (F.col("f_stat") - 1)
    out = out.withColumn("omega_squared", F.when(top + F.col("n") > 0, top / (top + F.col("n"))).otherwise(0.0))
    if not p_values:
        return out
    return out.withColumn("anova_p", dist.f_p("f_stat", F.col("k") - 1, F.col("n") - F.col("k"))).withColumn("kw_p", dist.chi2_p("kw_stat", F.col("k") - 1))


MOST_EVENTS = 100_000


def event_window(bars: DataFrame, keys: list[str], events: DataFrame, pre: int = 5, post: int = 5) -> DataFrame:
    """A row a (key, event_ms) with whole windows: mean and std of the pre bars before the first return at or after the
    event, and of the post bars from it on. events: event_ms, at most MOST_EVENTS different ones.

    Every return carries the sums of its windows; the as-of step counts, in one window over returns and events
    together, so no range join is needed.
    """
    marked = events.select("event_ms").distinct()
    if marked.limit(MOST_EVENTS + 1).count() > MOST_EVENTS:
        raise ValueError(f"more than {MOST_EVENTS} events")
    w = over(keys, "i")
    s = returns(bars, keys)
    a, b = w.rowsBetween(-pre, -1), w.rowsBetween(0, post - 1)
    s = s.select(*keys, "ts_ms", "i", *[f("x").over(o).alias(f"{n}_{m}") for n, o in (("pre", a), ("post", b)) for m, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))])
    marks = s.select(*keys).distinct().crossJoin(F.broadcast(marked))
    both = s.select(*keys, F.col("ts_ms").alias("at"), F.lit(1).alias("kind"), F.struct("ts_ms", "i", *[c for c in s.columns if "_" in c and c[:3] in ("pre", "pos")]).alias("row"))
    both = both.unionByName(marks.select(*keys, F.col("event_ms").alias("at"), F.lit(0).alias("kind")), allowMissingColumns=True)
    after = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    hit = both.withColumn("next", F.first("row", ignorenulls=True).over(after)).filter("kind = 0 AND next IS NOT NULL")
    hit = hit.select(*keys, F.col("at").alias("event_ms"), "next.*")
    return hit.filter((F.col("pre_n") == pre) & (F.col("post_n") == post)).select(*keys, "event_ms", "i", "pre_mean", "pre_std", "post_mean", "post_std")


def overnight_gaps(bars: DataFrame, keys: list[str], step_ms: int, boundary_minutes: int | None = None, edges: tuple[float, ...] = (0.0005, 0.001, 0.002), least: float = 0.0, lookahead: int = 48) -> DataFrame:
    """A row a gap: ts_ms, size, direction, bucket and bars_to_fill (null: not filled within `lookahead` bars).

    The fill is the first later bar that reaches the close before the gap. The extremes of the lookahead frame say
    whether there is one; filtering the frame's array finds it, so no join on a range is needed.
    """
    boundary = (boundary_minutes if boundary_minutes is not None else int(1.5 * step_ms / 60_000)) * 60_000
    w = over(keys)
    b = indexed(bars, keys).select(
        *keys, "i", "ts_ms", "close", F.lead("open").over(w).alias("next_open"), F.lead("ts_ms").over(w).alias("next_ms"),
        F.collect_list(F.struct("low", "high")).over(w.rowsBetween(1, lookahead)).alias("ahead"),
    )
    b = b.filter(F.col("next_ms") - F.col("ts_ms") > boundary).withColumn("size", (F.col("next_open") - F.col("close")) / F.col("close")).filter(F.abs("size") > least)
    place = F.when(F.abs("size") < edges[0], 0)
    for k, e in enumerate(edges[1:], 1):
        place = place.when(F.abs("size") < e, k)
    reach = F.transform("ahead", lambda x: F.when(F.col("size") > 0, x["low"] <= F.col("close")).otherwise(x["high"] >= F.col("close")))
    at = F.array_position(reach, F.lit(True))
    return b.select(*keys, F.col("next_ms").alias("ts_ms"), "size", F.when(F.col("size") > 0, "up").otherwise("down").alias("direction"), place.otherwise(len(edges)).alias("bucket"), F.when(at > 0, at.cast("int")).alias("bars_to_fill"))


def gap_table(gaps: DataFrame, keys: list[str], buckets: int = 4, least: int = 5) -> DataFrame:
    """A row for each key, direction and bucket: count, fills and fill_prob (null under `least`)."""
    dense = gaps.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction")).select(*keys, "direction", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    g = gaps.groupBy(*keys, "direction", "bucket").agg(F.count("*").alias("count"), F.count("bars_to_fill").alias("fills"))
    g = dense.join(g, [*keys, "direction", "bucket"], "left").fillna(0, ["count", "fills"])
    return g.withColumn("fill_prob", F.when(F.col("count") >= least, F.try_divide("fills", "count")))


def gap_headline(gaps: DataFrame, keys: list[str], sparse: int = 20) -> DataFrame:
    q = lambda p: F.percentile(F.abs("size"), F.lit(p))
    g = gaps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.try_divide(F.count("bars_to_fill"), F.count("*")), F.lit(0.0)).alias("fill_rate"), q(0.1).alias("p10"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.9).alias("p90"),
        F.percentile("bars_to_fill", F.lit(0.5)).alias("median_bars_to_fill"),
    )
    return g.withColumn("sparse_gaps", F.col("n") < sparse)


__all__ = ["HOUR", "SESSIONS", "anova_kruskal", "bucket_scan", "bucket_stats", "date_of", "event_window", "gap_headline", "gap_table", "in_session", "max_abs_t", "overnight_gaps"]
