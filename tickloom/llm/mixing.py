"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a word budget. Documents have a fixed 60-bit hash; a source takes those at or below a
threshold. Words are summed by source and hash bucket (12 bits), the bucket where the running sum meets the
budget is found, and only that bucket is split again by the next 12 bits, until one hash value is left. No rows
are sorted; only histograms meet in a window.

Defined cases: null texts have size 0; a null source is a source of its own, last in order; rows with one doc_id
share one hash and so are taken together; a null doc_id hashes as the empty string; an empty table gives an empty
result; other columns are ignored, and mixed() gives its own columns names that the table has not; texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut

BITS, LEVEL = 60, 12
#: A document with more than 1 / BIG of its source's words is decided first, by thresholds of its own, so that the many
#: small ones level out its error. A parameter of the method; both kinds are taken whole and by the same rule.
BIG = 1000
SPACE = "[ \\t-\\r]+"


def words(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09 to 0x0D."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}\\z", "")  # $ would also match before a last U+0085, U+2028 or U+2029
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE, -1))).cast("long")


def hash60(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """Adds target to (source, source_size).

    Sources weigh `weights`, repeating, in code-point order. Resharing by weight what exceeds the caps ends where
    every source under its cap has its weight times one rate; sources reach their caps in the order of cap / weight.
    The windows without a key hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = per_source.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    full = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    t = t.withColumn("before", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("w_left", F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(budget))
    t = t.withColumn("rate", (F.col("total") - F.col("before")) / F.col("w_left"))
    t = t.withColumn("open", F.col("rate") * F.col("w") < F.col("most"))
    rate = F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("last_rate", rate)
    target = F.when(F.col("last_rate").isNull(), F.col("most")).otherwise(F.least("most", F.col("last_rate") * F.col("w")))
    return t.select("source", "source_size", F.round(target, 6).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut, got): with the rows (source, size, h) at or under h = cut, the sum of sizes is nearest to the budget.

    budgets: (source, budget), one row per source. cut is -1 if nothing is taken.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    ended = []
    for level in range(BITS // LEVEL):
        shift = BITS - LEVEL * (level + 1)
        if level:
            inside = F.shiftright("h", shift + LEVEL)
            s = state.select(F.col("source").alias("s_source"), F.col("prefix").alias("s_prefix"))
            part = rows.join(s, rows["source"].eqNullSafe(F.col("s_source")) & (inside == F.col("s_prefix")), "left_semi")
        else:
            part = rows
        hist = part.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("cum", F.sum("size").over(run)).withColumnRenamed("source", "h_source")
        both = state.join(hist, state["source"].eqNullSafe(F.col("h_source")), "left")
        under = F.coalesce(F.col("base") + F.col("cum") <= F.col("budget"), F.lit(False))
        found = both.groupBy("source", "budget", "prefix", "base").agg(
            F.max(F.when(under, F.struct("bucket", "hi", "cum"))).alias("below"),
            F.min(F.when(~under & F.col("bucket").isNotNull(), F.struct("bucket", "lo", "hi", "size"))).alias("edge"),
        )
        low = F.col("base") + F.coalesce("below.cum", F.lit(0))
        alone = F.col("edge.lo") == F.col("edge.hi")
        take = alone & (low < F.col("budget")) & (low + F.col("edge.size") - F.col("budget") <= F.col("budget") - low)
        floor = F.when(F.col("edge").isNull(), F.coalesce("below.hi", F.lit(-1))).otherwise(F.shiftleft("edge.bucket", shift) - 1)
        found = found.select(
            "source", "budget", "edge.bucket", low.alias("low"),
            F.coalesce(F.col("edge").isNull() | alone | (F.col("budget") <= 0), F.lit(True)).alias("done"),
            F.when(F.col("budget") <= 0, -1).when(take, F.col("edge.hi")).otherwise(F.when(alone, F.col("edge.lo") - 1).otherwise(floor)).alias("cut"),
            F.when(F.col("budget") <= 0, 0).when(take, low + F.col("edge.size")).otherwise(low).alias("got"),
        )
        found = cut(found, "mix-level")
        ended.append(found.filter("done").select("source", "cut", "got"))
        state = found.filter("not done").select("source", "budget", F.col("bucket").alias("prefix"), F.col("low").alias("base"))
        if state.isEmpty():
            break
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    return out


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: its size, its target, how often each document is taken at least (full), and the thresholds
    under which big and small documents are taken once more."""
    sized = cut(docs.select(F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h")), "mix-sizes")
    return _plan(sized, weights, budget, cap)


def _plan(sized: DataFrame, weights, budget, cap) -> DataFrame:
    per = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap), "mix-targets")
    full = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.try_divide("target", "source_size"))).cast("long")
    per = per.withColumn("full", F.coalesce(full, F.lit(0).cast("long"))).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    p = per.select(F.col("source").alias("p_source"), "source_size")
    rows = sized.join(p, sized["source"].eqNullSafe(F.col("p_source"))).withColumn("big", F.col("size") * BIG > F.col("source_size")).select("source", "size", "h", "big")
    rows = cut(rows, "mix-rows")
    big_sum = rows.filter("big").groupBy(F.col("source").alias("b_source")).agg(F.sum("size").alias("big_size"))
    per = per.join(big_sum, per["source"].eqNullSafe(F.col("b_source")), "left").drop("b_source")
    share = F.coalesce(F.try_divide(F.col("rest") * F.coalesce("big_size", F.lit(0)), "source_size"), F.lit(0.0))
    per = cut(per.withColumn("big_budget", share), "mix-plan")
    first = thresholds(rows.filter("big").select("source", "size", "h"), per.select("source", F.col("big_budget").alias("budget")))
    f = first.select(F.col("source").alias("f_source"), F.col("cut").alias("big_cut"), F.col("got").alias("big_got"))
    per = cut(per.join(f, per["source"].eqNullSafe(F.col("f_source")), "left").drop("f_source"), "mix-plan")
    then = thresholds(rows.filter("not big").select("source", "size", "h"), per.select("source", (F.col("rest") - F.col("big_got")).alias("budget")))
    t = then.select(F.col("source").alias("f_source"), F.col("cut").alias("small_cut"))
    return cut(per.join(t, per["source"].eqNullSafe(F.col("f_source")), "left").select("source", "source_size", "target", "full", "big_cut", "small_cut"), "mix-plan")


def copies(size: Column) -> Column:
    """How often the plan's row joined to a document takes it; needs the columns h and those of plan()."""
    edge = F.when(size * BIG > F.col("source_size"), F.col("big_cut")).otherwise(F.col("small_cut"))
    return F.col("full") + (F.col("h") <= edge).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), copies and taken (words, repeats counted)."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h")), "mix-sizes")
    p = _plan(rows.select("source", "size", "h"), weights, budget, cap).withColumnRenamed("source", "p_source")
    got = rows.join(p, rows["source"].eqNullSafe(F.col("p_source"))).withColumn("copies", copies(F.col("size")))
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents themselves, with all their columns, each as often as the mix takes it."""
    p = plan(docs, weights, budget, cap)
    own = "mix_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    p = p.select(*[F.col(c).alias(own + c) for c in p.columns])
    edge = F.when(words(F.col("text")) * BIG > F.col(f"{own}source_size"), F.col(f"{own}big_cut")).otherwise(F.col(f"{own}small_cut"))
    n = F.col(f"{own}full") + (hash60(F.col("doc_id")) <= edge).cast("long")
    both = docs.join(p, docs["source"].cast("string").eqNullSafe(F.col(f"{own}source")))
    return both.withColumn(f"{own}copy", F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))).select(*[docs[c] for c in docs.columns])


#: The same in DuckDB: running sums over all rows in hash order stand for the thresholds.
SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS most FROM s
), f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM w
), r AS (
  SELECT *, (total - before) / w_left AS rate FROM f
), l AS (
  SELECT arg_min(rate, most / w) FILTER (rate * w < most) AS last_rate FROM r
), t AS (
  SELECT source, source_size, round(CASE WHEN last_rate IS NULL THEN most ELSE least(most, last_rate * w) END, 6) AS target FROM r, l
), p AS (
  SELECT *, coalesce(CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END, 0) AS full_n FROM t
), e AS (
  SELECT d.*, p.source_size, p.target, p.full_n, p.target - p.full_n * p.source_size AS rest, d.size * 1000 > p.source_size AS big
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), u AS (
  SELECT source, big, h, CAST(sum(size) AS BIGINT) AS size, any_value(rest) AS rest, any_value(source_size) AS source_size FROM e GROUP BY ALL
), bb AS (
  SELECT source, any_value(rest) * coalesce(sum(size) FILTER (big), 0) / nullif(any_value(source_size), 0) AS big_budget FROM u GROUP BY source
), ub AS (
  SELECT u.*, coalesce(big_budget, 0) AS budget, sum(size) OVER (PARTITION BY u.source ORDER BY h) AS cum
  FROM u JOIN bb ON u.source IS NOT DISTINCT FROM bb.source WHERE big
), tb AS (
  SELECT *, budget > 0 AND (cum <= budget OR (cum - size < budget AND cum - budget <= budget - (cum - size))) AS take FROM ub
), got AS (
  SELECT p.source, coalesce(g.got, 0) AS got FROM p LEFT JOIN (SELECT source, sum(size) FILTER (take) AS got FROM tb GROUP BY source) g ON p.source IS NOT DISTINCT FROM g.source
), us AS (
  SELECT u.*, u.rest - got.got AS budget, sum(size) OVER (PARTITION BY u.source ORDER BY h) AS cum
  FROM u JOIN got ON u.source IS NOT DISTINCT FROM got.source WHERE NOT big
), ts AS (
  SELECT *, budget > 0 AND (cum <= budget OR (cum - size < budget AND cum - budget <= budget - (cum - size))) AS take FROM us
), k AS (
  SELECT source, big, h, take FROM tb UNION ALL SELECT source, big, h, take FROM ts
)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(e.size * (e.full_n + CAST(k.take AS BIGINT)) AS BIGINT) AS taken
FROM e JOIN k ON e.source IS NOT DISTINCT FROM k.source AND e.big = k.big AND e.h = k.h
"""
