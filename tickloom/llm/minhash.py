"""Circulant MinHash near-duplicates: banded signatures, exact Jaccard confirmation, connected components.

A document's set holds the 64-bit hashes of its distinct k-word shingles (words end at space and 0x09 to 0x0D, A-Z in
lower case; fewer than k words: the whole sequence is one shingle). Signature coordinate i is the least
pi(sigma(x) + i * STEP mod 2^32) over the set: sigma and pi are two permutations of the 32-bit integers, and pi is
shifted in a circle. BANDS bands of ROWS coordinates give the keys under which sets meet. At likeness 0.8 a pair
shares 13 keys on average and misses two with a chance of 3e-6.

Equal sets are one class, named by its smallest doc_id; only classes meet. Where sets share a key, each is first
confirmed against one pivot (that of the most crowded keys), not against each other. What then lies in one component
needs no more pairs. Under the keys where components still meet, every set is written as its differences to the key's
pivot. A set u without a link to the pivot p can be linked to a set y only if both have the same differences to p in
t = need(u, y) - |p| + |p - u| + |p - y| places at least, where need() is the least intersection at the threshold. As t is over 0
for all such u and y, one of the rarest |differences| - t + 1 differences of each is common to both (prefix
filtering), and a join on these finds every pair that may be linked; no link that a shared key shows is lost, and members
of a large group do not meet each other.

Defined cases: null or wordless texts have no shingles, are linked with nothing and are kept; a null doc_id never
names a component while its class has another; rows with one doc_id are one document and are kept or go together;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored; a text of any
length is one set, made in one worker. kept() counts each row as a document of its own, so of repeated rows with words one stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, forget, lean, only, rows_of, texts, worker_cache

BANDS, ROWS = 40, 5
STEP = 0x9E3779B1
SHARED = 2
#: Most bits of the Bloom filter of documents that share keys (16 MB). Where a tenth as many documents or more share keys, a join picks them.
BLOOM = 1 << 27
KEPT_WORDS = 1 << 18
_words: dict[bytes, int] = worker_cache()


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct hashes."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and space and 0x09 to 0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > KEPT_WORDS:
        _words.clear()
    h = np.fromiter((_words.get(w) or _words.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _permuted(x: np.ndarray, a: int, b: int, tmp: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    for shift, factor in ((16, a), (15, b)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    return np.bitwise_xor(x, tmp, out=x)


def signatures(sets: list[np.ndarray], n: int = BANDS * ROWS) -> np.ndarray:
    """(n, sets); every set has a member."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x, tmp, y = (flat >> np.uint64(32)).astype(np.uint32), np.empty(len(flat), np.uint32), np.empty(len(flat), np.uint32)
    _permuted(x, 0x7FEB352D, 0x846CA68B, tmp)
    out = np.empty((n, len(sets)), np.uint32)
    for i in range(n):
        np.add(x, np.uint32(i * STEP & 0xFFFFFFFF), out=y)
        out[i] = np.minimum.reduceat(_permuted(y, 0x21F0AAAD, 0xD35A2D97, tmp), starts)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) of 64-bit keys that also tell the band."""
    bands = sig.reshape(-1, rows, sig.shape[1]).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + np.zeros((1, sig.shape[1]), np.uint64)
    for r in range(rows):
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + bands[:, r]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).T.view(np.int64)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, cls (the set's hash; null if empty) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_words)
        for b in rows_of(lean(batches), 1 << 20):
            sets = [shingles(t, k) for t in b["text"].to_pylist()]
            cls = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            first = {c: i for i, c in reversed(list(enumerate(cls))) if c is not None}
            keys = dict(zip(first, band_keys(signatures([sets[i] for i in first.values()])).tolist(), strict=True)) if first else {}
            yield pa.record_batch([b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array([keys.get(c) for c in cls], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cls", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls binary, keys array<long>")


def bloom(ids: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the ids (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(own, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.record_batch([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["part"])

    out = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(8).mapInArrow(run, "part binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r["part"]), np.uint8)
    return out.tobytes()


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return [(x * np.uint64(f) >> np.uint64(20)) % np.uint64(bits) for f in (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def sets_of(docs: DataFrame, ids: DataFrame, k: int, most: int = BLOOM) -> DataFrame:
    """id and shingles (8 bytes each, sorted) of the documents in ids (distinct), and of a few more that the Bloom filter lets through."""
    n = ids.count()
    bits = max(1 << 16, 1 << (10 * n).bit_length())
    if bits > most:
        docs, spread = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), None
    else:
        spread = docs.sparkSession.sparkContext.broadcast(bloom(ids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_words)
        for b in rows_of(lean(batches)):
            b = b.filter(b["doc_id"].is_valid())
            if spread:
                have = np.frombuffer(spread.value, np.uint8)
                at = _places(b["doc_id"].to_numpy(zero_copy_only=False), bits)
                b = b.filter(pa.array(np.logical_and(*[(have[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in at])))
            if b.num_rows:
                yield pa.record_batch([b["doc_id"], pa.array([shingles(t, k).tobytes() for t in b["text"].to_pylist()], pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (x, y) with their sets sx and sy."""
    one = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx")), "x")
    return one.join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy")), "y").select("x", "y", "sx", "sy")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            ok = []
            for s, t in zip(b["sx"].to_pylist(), b["sy"].to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = np.sort(np.concatenate([s, t]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield b.filter(pa.array(ok, pa.bool_())).select(["x", "y"])

    return _with_sets(pairs, sets).mapInArrow(run, "x long, y long")


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of each set x and its pivot y: n and m (their sizes), a (the pivot's shingles that x lacks: how many), linked, and d, all
    shingles that one of them has and the other has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            rows = []
            for s, t in zip(b["sx"].to_pylist(), b["sy"].to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                d = np.setxor1d(s, t, assume_unique=True)
                same = (len(s) + len(t) - len(d)) // 2
                rows.append((len(s), len(t), len(t) - same, 100 * same >= percent * (len(s) + len(t) - same), d.view(np.int64)))
            n, m, a, linked, d = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.record_batch([b["x"], b["y"], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(a, pa.int64()), pa.array(linked, pa.bool_()), pa.array(d, pa.list_(pa.int64()))], ["id", "pivot", "n", "m", "a", "linked", "d"])

    return _with_sets(pairs, sets).mapInArrow(run, "id long, pivot long, n long, m long, a long, linked boolean, d array<long>")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id and component (the smallest id it reaches) of every id in edges (x, y), by alternating large and small stars.

    Every step is a join and an aggregation, written to the shared folder.
    """

    def is_star(e: DataFrame) -> bool:
        """No id has two edges to smaller ids, nor is one end of an edge the start of another."""
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("x")).select("x.*")
        return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()

    e = cut(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most):
        if is_star(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        new = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = new.groupBy("u").agg(F.min("v").alias("m"))
        new = new.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, e = e, cut(new.filter("u <> v").distinct(), "edges")
        forget(old)
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out.scratch_path = e.scratch_path
    return out


def groups(docs: DataFrame, k: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked through any chain) and kept."""
    rows = texts(docs, id_col, text_col)
    sig = cut(signed(rows, k), "minhash")
    reps = cut(sig.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")
    links = _links(rows, sig, reps, k, percent)
    named = reps.join(links.withColumnRenamed("id", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(rows: DataFrame, sig: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    named = reps.filter("rep IS NOT NULL").select("cls", F.col("rep").alias("doc_id"), "n")
    mine = sig.select("doc_id", "cls", "keys").join(named, ["doc_id", "cls"]).select(F.col("doc_id").alias("id"), "n", F.explode("keys").alias("key"))
    crowd = mine.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    every = cut(mine.join(crowd, "key").select("key", "id", "n", "c"), "met")
    score = every.groupBy("id").agg(F.sum("c").alias("score"), F.count("*").alias("keys")).filter(F.col("keys") >= SHARED)
    met = cut(every.join(score.select("id", "score"), "id").select("key", "id", "n", "c", "score"), "met")
    forget(every)
    sets = cut(sets_of(rows, met.select("id").distinct(), k), "sets")
    pivots = met.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"), "n")).alias("p")).select("key", (-F.col("p.neg")).alias("pivot"), F.col("p.n").alias("pn"))
    fits = lambda a, b: F.greatest(a, b) * percent <= F.least(a, b) * 100
    star = met.join(pivots, "key").filter((F.col("id") != F.col("pivot")) & fits(F.col("n"), F.col("pn")))
    star = cut(star.groupBy(F.col("id").alias("x"), F.col("pivot").alias("y")).agg(F.count("*").alias("shared")).filter(F.col("shared") >= SHARED), "star")
    best = star.groupBy("x").agg(F.max(F.struct("shared", (-F.col("y")).alias("neg"))).alias("b")).select("x", (-F.col("b.neg")).alias("y"))
    first = _settled(confirmed(best, sets, percent))
    # under the keys where components still meet: all sets against the pivot, as differences
    at = met.join(pivots.select("key", "pivot"), "key").join(first, "id", "left").select("key", "id", "c", "pivot", F.coalesce("component", "id").alias("part"))
    mixed = at.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    members = at.join(mixed, "key").filter("id <> pivot").groupBy(F.col("id").alias("x"), F.col("pivot").alias("y")).agg(F.count("*").alias("shared"), F.max("c").alias("c"))
    apart = cut(differences(members.filter(f"c > 2 OR shared >= {SHARED}").select("x", "y"), sets, percent), "differences")
    tied = first.select(F.col("id").alias("x"), F.col("component").alias("y"))
    parts = _settled(tied.unionByName(apart.filter("linked").select(F.col("id").alias("x"), F.col("pivot").alias("y"))))
    lone = cut(_lone(apart, parts), "differences")
    rest = cut(confirmed(_prefixed(lone, percent), sets, percent), "links")
    out = _settled(parts.select(F.col("id").alias("x"), F.col("component").alias("y")).unionByName(rest))
    forget(met, sets, star, first, apart, parts, lone, rest)
    return out


def _settled(edges: DataFrame) -> DataFrame:
    found = components(edges)
    out = cut(found, "parts")
    forget(found)
    return out


def _lone(apart: DataFrame, parts: DataFrame) -> DataFrame:
    """The sets of pivots that a set without a link to them (lone) has, with their components."""
    named = apart.select("pivot", "id", "n", "m", "a", "d").join(parts.select("id", F.col("component").alias("part")), "id", "left")
    named = named.join(parts.select(F.col("id").alias("pivot"), F.col("component").alias("home")), "pivot", "left").withColumn("part", F.coalesce("part", "id"))
    named = named.withColumn("lone", F.col("part") != F.coalesce("home", "pivot")).drop("home")
    return named.join(named.filter("lone").select("pivot").distinct(), "pivot", "left_semi")


def _prefixed(lone: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) in different components that may be linked, of sets that have a pivot in common; x has no link to it."""
    full = 100 + percent
    each = lone.select("pivot", "id", "n", "m", "a", "part", "lone", F.explode("d").alias("e"))
    # differences that no lone set shares with another cannot be common; the others count from the most frequent back
    known = each.groupBy("pivot", "e").agg(F.count("*").alias("f"), F.max("lone").alias("any")).filter("f > 1 AND any").select("pivot", "e", "f")
    order = Window.partitionBy("pivot", "id").orderBy(F.desc("f"), F.desc("e"))
    each = each.join(known, ["pivot", "e"]).withColumn("back", F.row_number().over(order)).drop("f")
    # back >= t, for the least t that any partner leaves
    x = each.filter(f"lone AND {full} * (back + m - a) >= {percent} * (n + m)")
    y = each.filter(f"{full} * (back - a) > {percent} * (n - m)")
    x = x.select("pivot", "e", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "a", "part", "back", "m")])
    y = y.select("pivot", "e", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "a", "part", "back", "lone")])
    t = F.expr(f"({percent} * (x_n + y_n) + {full - 1}) div {full} - x_m + x_a + y_a")
    fits = F.greatest("x_n", "y_n") * percent <= F.least("x_n", "y_n") * 100
    pairs = x.join(y, ["pivot", "e"]).filter(F.expr("x_part <> y_part AND (NOT y_lone OR x_id < y_id)") & fits & (F.col("x_back") >= t) & (F.col("y_back") >= t))
    return pairs.select(F.least("x_id", "y_id").alias("x"), F.greatest("x_id", "y_id").alias("y")).distinct()


def kept(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns kept, of which one of each group stays: that of the smallest doc_id (null last).

    Every row is a document of its own, with a key in a table in the shared folder.
    """
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = groups(held, k, percent, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long").alias("doc_id"), F.col(row)))
    stay = found.join(held.select(row, "doc_id"), row).groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    return held.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same in DuckDB, for small tables: all pairs of sets that share a shingle, and a recursive search.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(ws) - {k} + 2), lambda i: list_aggregate(ws[i:i + {k} - 1], 'string_agg', ' ')) END)) AS sh FROM w
), c AS (
  SELECT min(doc_id) AS rep, sh FROM s WHERE len(sh) > 0 GROUP BY sh
), u AS (
  SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c
), p AS (
  SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep AND greatest(a.n, b.n) * 80 <= least(a.n, b.n) * 100
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) * 100 >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT x, y FROM p UNION SELECT y, x FROM p
), r AS (
  SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), k AS (
  SELECT x, min(y) AS component FROM r GROUP BY x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(k.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN k ON k.x = c.rep
"""
