"""Secret scans: three base patterns, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

Positions come from the pieces between matches: piece lengths and match lengths add up to starts, in code points; they
are added up in blocks of BLOCK matches, and the blocks' sums then over the blocks, so that no long array is copied for each match.
A candidate is a run of 20 or more of [A-Za-z0-9+/_=-]; its class is the narrowest of hex, alnum and base64 that
holds it. A window of 20 characters slides over it; with f(c) = c log2 c in fixed point, the sum S of f over the
window's character counts changes by the counts of the entering and the leaving character only, and the window's
entropy is log2 20 - S / 20. The counts are carried along, 12 of them in the bits of one integer. The span is the hull
of the windows that reach the class's threshold. Candidates that match the allow list give no span. alnum and base64 candidates need a digit and a letter.

Defined cases: a null text counts as empty; a null doc_id stays; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored; time grows in proportion to the length of a text and of a candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import texts

# The base patterns. Their tails are greedy, so a minimum length may stand in the pattern where one run can
# hold no second match of it (access, hex); the value of an assignment is measured after the match instead.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALLOW = "(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxx|0123456789|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

KINDS = ("assign", "access", "hex", "entropy")
WIDTH = 20
SCALE = 1_000_000
#: Least bits per character of a window, by class.
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
TABLE = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WIDTH + 2)]
#: Counts of 5 bits that an integer holds, and integers for the characters from "+" to "z".
PACK, PACKS = 12, 7
BLOCK = 256
#: Characters that redacted() cuts from a text at once.
CUT = 4096
#: The most that S may be, by class.
MOST = {k: math.floor((math.log2(WIDTH) - bits) * WIDTH * SCALE) for k, bits in BITS.items()}

SPAN = "struct<s:bigint,k:int,e:bigint>"


def found(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """array<struct<s, k, e, m>> of the pattern's matches, leftmost and non-overlapping; m is the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint,m:string>>)")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def span(s: Column, m: Column, end: Column) -> Column:
        return F.struct(s.cast("long").alias("s"), F.lit(kind).alias("k"), end.cast("long").alias("e"), m.alias("m"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.cast("long").alias("at"), F.concat(a["out"], F.array(span(s, x["m"], e))).alias("out"))

    def placed(blocks: Column) -> Column:
        before = _run(F.transform(blocks, lambda b: b["at"]), 0, lambda x, y: x + y)["out"]
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda x: span(x["s"] + at, x["m"], x["e"] + at))))

    def in_blocks(pairs: Column) -> Column:
        return _bound(F.transform(_blocks(pairs), lambda b: F.aggregate(b, zero, step)), placed)

    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    return F.when(text.rlike(pattern), _bound(pairs, in_blocks)).otherwise(none)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    """The array (not empty) in stretches of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def _run(values: Column, start: int, op) -> Column:
    """struct<at, out>: op over all values (long), and before each value over those before it."""
    zero = F.struct(F.lit(start).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(values, zero, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))


def _before(values: Column, start: int, op) -> Column:
    """Before each value (long), op over the ones before it."""

    def over(runs: Column) -> Column:
        ahead = _run(F.transform(runs, lambda r: r["at"]), start, op)["out"]
        return F.flatten(F.zip_with(runs, ahead, lambda r, at: F.transform(r["out"], lambda x: op(at, x))))

    return _bound(values, lambda v: _bound(F.transform(_blocks(v), lambda b: _run(b, start, op)), over))


def windows(word: Column, most: Column) -> Column:
    """struct<lo, hi>: 0-based start of the first and end of the last window of `word` with S at most `most`; lo is null if there is none."""
    table = F.array(*[F.lit(x).cast("long") for x in TABLE])

    def f(c: Column) -> Column:
        return F.element_at(table, (c + 1).cast("int"))

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.element_at(counts, (F.floor(code / PACK) + 1).cast("int")), code % PACK * 5).bitwiseAND(F.lit(31).cast("long"))

    def one(code: Column, j: Column) -> Column:
        return F.when(F.floor(code / PACK) == j, F.call_function("shiftleft", F.lit(1).cast("long"), code % PACK * 5)).otherwise(F.lit(0).cast("long"))

    def step(a: Column, x: Column) -> Column:
        had = count(a["c"], x["new"])
        s1 = a["s"] + f(had + 1) - f(had)
        full = x["old"] >= 0
        was = count(a["c"], x["old"]) + (x["old"] == x["new"]).cast("long")
        s2 = F.when(full, s1 - f(was) + f(was - 1)).otherwise(s1)
        c = F.transform(a["c"], lambda v, j: v + one(x["new"], j) - F.when(full, one(x["old"], j)).otherwise(F.lit(0).cast("long")))
        i = a["i"] + 1
        hit = (i >= WIDTH) & (s2 <= a["most"])
        return F.struct(i.alias("i"), a["most"].alias("most"), s2.alias("s"), c.alias("c"), F.when(hit & a["lo"].isNull(), i - WIDTH).otherwise(a["lo"]).alias("lo"), F.when(hit, i).otherwise(a["hi"]).alias("hi"))

    def slid(codes: Column) -> Column:
        old = F.slice(F.concat(F.array_repeat(F.lit(-1), WIDTH), codes), F.lit(1), F.size(codes))
        none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
        start = F.struct(F.lit(0).alias("i"), most.alias("most"), zero.alias("s"), F.array(*[zero] * PACKS).alias("c"), none.alias("lo"), none.alias("hi"))
        return F.aggregate(F.zip_with(codes, old, lambda n, o: F.struct(n.alias("new"), o.alias("old"))), start, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))

    return _bound(F.transform(F.slice(F.split(word, ""), F.lit(1), F.length(word)), lambda c: F.ascii(c) - ord("+")), slid)


def entropy_spans(text: Column) -> Column:
    cands = F.filter(found(text, CANDIDATE, 3), lambda x: ~x["m"].rlike(ALLOW) & (x["m"].rlike("^[0-9A-Fa-f]+$") | (x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))))

    def one(x: Column) -> Column:
        most = F.when(x["m"].rlike("^[0-9A-Fa-f]+$"), MOST["hex"]).when(x["m"].rlike("^[0-9A-Za-z]+$"), MOST["alnum"]).otherwise(MOST["base64"]).cast("long")
        w = windows(x["m"], most)
        return _bound(w, lambda y: F.struct((x["s"] + y["lo"]).cast("long").alias("s"), x["k"].alias("k"), (x["s"] + y["hi"]).cast("long").alias("e")))

    return F.filter(F.transform(cands, one), lambda x: x["s"].isNotNull())


def base_of(text: Column) -> Column:
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    value = lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}", 2)) >= 12
    return F.array_sort(F.concat(bare(F.filter(found(text, ASSIGN, 0), value)), bare(found(text, ACCESS, 1)), bare(found(text, HEX, 2))))


def spans_of(text: Column) -> Column:
    return F.array_sort(F.concat(base_of(text), entropy_spans(text)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans: arrays of struct<s, k, e> (start, index in KINDS, end exclusive; code points), in order."""
    got = docs.select("doc_id", "text", base_of(F.col("text")).alias("base"), entropy_spans(F.col("text")).alias("more"))
    return got.select("doc_id", "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    got = scan(texts(docs))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return got.select("doc_id", n(0), n(1), n(2), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by the mark; overlapping or touching spans give one mark."""
    # the furthest end before each span
    ends = _before(F.transform(spans, lambda x: x["e"]), -1, F.greatest)

    def joined(blocks: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            """The characters from a to b; a block costs its own length only."""
            start = lambda j: F.greatest(a - j * CUT, F.lit(0).cast("long"))
            each = F.transform(F.sequence(F.floor(a / CUT), F.floor((b - 1) / CUT)), lambda j: F.substring(F.get(blocks, j.cast("int")), (start(j) + 1).cast("int"), (F.least(b - j * CUT, F.lit(CUT).cast("long")) - start(j)).cast("int")))
            return F.when(b > a, F.array_join(each, "")).otherwise("")

        marks = F.zip_with(spans, ends, lambda x, p: F.when(x["s"] > p, F.concat(part(F.greatest(p, F.lit(0).cast("long")), x["s"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(marks, ""), part(F.array_max(F.transform(spans, lambda x: x["e"])), F.length(text).cast("long")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(_bound(blocks, joined))


def _sql_spans(pattern: str, kind: int, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, rid, {kind} AS k, m, len_before AS s, len_before + length(m) AS e FROM (
  SELECT doc_id, rid, m, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS len_before
  FROM (SELECT doc_id, rid, pieces, hits, unnest(hits) AS m, generate_subscripts(hits, 1) AS i
        FROM (SELECT doc_id, rid, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS hits FROM t)))
WHERE {keep}"""


def _sql() -> str:
    assign = ASSIGN.replace("'", "''")
    table = "[" + ", ".join(map(str, TABLE)) + "]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {{docs}}),
b AS (
{_sql_spans(ASSIGN, 0, f"length(regexp_extract(m, '^{assign}', 2)) >= 12")}
UNION ALL
{_sql_spans(ACCESS, 1)}
UNION ALL
{_sql_spans(HEX, 2)}
), c AS (
SELECT *, CASE WHEN regexp_matches(m, '^[0-9A-Fa-f]+$') THEN {MOST["hex"]} WHEN regexp_matches(m, '^[0-9A-Za-z]+$') THEN {MOST["alnum"]} ELSE {MOST["base64"]} END AS most FROM (
{_sql_spans(CANDIDATE, 3)}
) WHERE NOT regexp_matches(m, '{ALLOW}') AND (regexp_matches(m, '^[0-9A-Fa-f]+$') OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')))
), w AS (
SELECT doc_id, rid, s, most, i, substr(m, i + 1, {WIDTH}) AS win FROM (SELECT *, unnest(range(length(m) - {WIDTH} + 1)) AS i FROM c)
), h AS (
SELECT doc_id, rid, s, i FROM w WHERE list_sum(list_transform(list_distinct(string_split(win, '')), lambda x: ({table})[length(win) - length(replace(win, x, '')) + 1])) <= most
), n AS (
SELECT doc_id, rid, 3 AS k, min(s + i) AS s, max(s + i) + {WIDTH} AS e FROM h GROUP BY doc_id, rid, s
), a AS (
SELECT rid, k, s, e, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e AS w FROM (SELECT rid, k, s, e FROM b UNION ALL SELECT rid, k, s, e FROM n)
), g AS (
SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(w, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(w, ',' ORDER BY s, k) AS spans FROM a GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)
"""


SQL = _sql()


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with secrets in their text replaced by the mark (and n_chars, where there is such a
    column, counted anew); documents without secrets are unchanged."""
    have = {c.lower() for c in docs.columns}
    name = "spans"
    while name in have:
        name += "_"
    found = F.coalesce(F.size(name), F.lit(0)) > 0
    got = docs.withColumn(name, F.when(F.col("text").isNotNull(), spans_of(F.col("text"))))
    got = got.withColumn("text", F.when(found, redacted(F.col("text"), F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return got.drop(name)
