"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find all within a Hamming radius.

Terms are 2-word shingles (split at space and 0x09 to 0x0D, A-Z in lower case) with weight 1 + ln(count); a text of
fewer than two words votes with its 3-grams of characters. 128 bits; ties give 0 bits; a fingerprint is 32 hex digits.

Defined cases: a null text counts as empty and has the fingerprint 0; null doc_ids come last; rows with one doc_id
follow each other in the order of their texts; a single row is its own next document; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, only, partitions, rows_of, texts, worker_cache

BITS = 128
_SIGN = (2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1).astype(np.float64)
_AT = (np.arange(BITS // 8) * 256)[None, :]
#: Words whose hashes a worker keeps at once.
KEPT_WORDS = 1 << 18
_words: dict[bytes, int] = worker_cache()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _terms(text: str) -> np.ndarray:
    words = text.encode().lower().split()  # of bytes: A-Z only, and space and 0x09 to 0x0D only
    if len(words) < 2:
        words = [text[i : i + 3] for i in range(max(1, len(text) - 2))] if text else []
        return np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))
    if len(only(_words)) > KEPT_WORDS:
        _words.clear()
    h = np.fromiter((_words.get(w) or _words.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    return _mix(h[:-1], 7) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))


def fingerprint(text: str) -> bytes:
    if not text:
        return bytes(BITS // 8)
    terms, n = np.unique(_terms(text), return_counts=True)
    votes = np.zeros((BITS // 8, 8))
    for i in range(0, len(terms), 1 << 16):
        part, w = terms[i : i + (1 << 16)], 1 + np.log(n[i : i + (1 << 16)])
        octets = np.concatenate([_mix(part, 0x51)[:, None], _mix(part, 0xA3)[:, None]], axis=1).view(np.uint8)
        votes += np.bincount((octets + _AT).ravel(), np.repeat(w, BITS // 8), 256 * BITS // 8).reshape(-1, 256) @ _SIGN
    return np.packbits(votes > 1e-9, axis=1).ravel().tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        yield pa.record_batch([b["doc_id"], pa.array([fingerprint(t).hex() for t in b["text"].to_pylist()])], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint."""
    return texts(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fingerprint string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _row(doc_id, text: str, own: bytes, following: str, its: bytes) -> tuple:
    e = edited(text, following)
    fp = own if e == text else fingerprint(e)
    return doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), own.hex(), fp.hex(), likeness(own, fp), likeness(own, its)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order: a result for each but the last; the texts of the first (kind 1) and the last (kind 2)."""
    schema = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    pid, held = TaskContext.get().partitionId(), None
    make = lambda rows: pa.RecordBatch.from_pylist(rows, schema)
    for b in rows_of(batches):
        rows = []
        for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            fp = fingerprint(t)
            if held is None:
                rows.append({"kind": 1, "pid": pid, "text": t, "doc_id": i})
            else:
                rows.append({"kind": 0, "pid": pid} | dict(zip(_NAMES, _row(*held, t, fp), strict=True)))
            held = i, t, fp
        yield make(rows)
    if held is not None:
        yield make([{"kind": 2, "pid": pid, "text": held[1], "doc_id": held[0]}])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        rows = [_row(i, t, fingerprint(t), f, fingerprint(f)) for i, t, f in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], pa.schema([(n, pa.int64() if n in ("doc_id", "n_chars") else pa.float64() if n.startswith("near") else pa.string()) for n in _NAMES]))


def against_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness and the likeness to the next document's.

    The texts move once, by ranges of doc_id. Only the first and last text of each partition meet their neighbours in
    a join, whose window has one row a partition.
    """
    t = texts(docs)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = t.repartitionByRange(4 * partitions(docs.sparkSession), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    done = cut(dealt.mapInArrow(_in_order, f"kind int, pid int, text string, {RESULT}"), "simhash")
    heads = done.filter("kind = 1").select("pid", F.col("text").alias("following"))
    ring = Window.orderBy("pid")
    turn = heads.select("pid").withColumn("to", F.coalesce(F.lead("pid").over(ring), F.first("pid").over(ring)))
    tails = done.filter("kind = 2").select("pid", "doc_id", "text").join(turn, "pid")
    edges = tails.join(heads.withColumnRenamed("pid", "to"), "to").select("doc_id", "text", "following")
    return done.filter("kind = 0").select(*_NAMES).unionByName(edges.mapInArrow(_at_edges, RESULT))


def near(fps: DataFrame, queries: DataFrame, radius: int = 3, spare: int = 1) -> DataFrame:
    """(q, fingerprint, distance) for all pairs of distinct fingerprints of queries and of fps at most `radius` bits apart.

    The bits form radius + spare blocks. Two fingerprints within the radius agree in `spare` blocks at least, so one
    table for each choice of `spare` blocks (a permutation that puts these first) finds every pair by an equality of
    keys. Equal fingerprints are one class, so large groups of copies cost one row.
    """
    k = radius + spare
    edge = [round(i * BITS / 4 / k) for i in range(k + 1)]  # in hex digits
    tables = list(combinations(range(k), spare))

    def keyed(df: DataFrame) -> DataFrame:
        blocks = [F.expr(f"substring(fingerprint, {a + 1}, {b - a})") for a, b in zip(edge, edge[1:], strict=False)]
        keys = F.array(*[F.concat_ws("-", F.lit(str(j)), *[blocks[i] for i in t]) for j, t in enumerate(tables)])
        return df.select("fingerprint", F.explode(keys).alias("key"))

    number = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    apart = sum((F.bit_count(number(F.col("fingerprint"), i).bitwiseXOR(number(F.col("q"), i))) for i in range(BITS // 32)), F.lit(0))
    mine, theirs = fps.select("fingerprint").distinct(), queries.select("fingerprint").distinct()
    pairs = keyed(mine).join(keyed(theirs).withColumnRenamed("fingerprint", "q"), "key").select("fingerprint", "q").distinct()
    return pairs.withColumn("distance", apart.cast("int")).filter(F.col("distance") <= radius)


def within(fps: DataFrame, queries: DataFrame, radius: int = 3, spare: int = 1) -> DataFrame:
    """(query_id, doc_id, distance) for all pairs of documents whose fingerprints are at most `radius` bits apart: near()
    with the classes' members written out. fps and queries: doc_id and fingerprint."""
    found = near(fps, queries, radius, spare).join(queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q")), "q")
    return found.join(fps.select("doc_id", "fingerprint"), "fingerprint").select("query_id", "doc_id", "distance")


def digest(docs: DataFrame, radius: int = 3, spare: int = 1) -> DataFrame:
    """against_next(), and for each document whose doc_id is divisible by 100 (null otherwise) near_classes and near_docs:
    the distinct fingerprints within `radius` bits of its own, which counts, and the documents that have them."""
    got = cut(against_next(docs), "simhash-rows")
    asked = got.filter("doc_id % 100 = 0")
    size = got.groupBy("fingerprint").agg(F.count("*").alias("docs"))
    per = near(got, asked, radius, spare).join(size, "fingerprint").groupBy(F.col("q").alias("fingerprint")).agg(F.count("*").alias("near_classes"), F.sum("docs").alias("near_docs"))
    none = F.lit(None).cast("long")
    rest = got.filter("doc_id IS NULL OR doc_id % 100 <> 0").select(*_NAMES, none.alias("near_classes"), none.alias("near_docs"))
    return rest.unionByName(asked.join(per, "fingerprint").select(*_NAMES, "near_classes", "near_docs"))
