"""A gated recurrent language model in numpy, and whole-document log-likelihoods.

Counts of all words of the training documents come from the whole corpus. The `MODEL` most frequent words, one token
for all other words and one for a document's end are the network's tokens. It is trained by truncated backpropagation
(windows of STEPS tokens, LANES side by side, the state carried over, reset where a document begins) on all training
documents, whole, each once: every partition deals them out in turn to ROUNDS rounds, in each of which every partition trains from
the same weights over its documents of that round, and the weights' means, by tokens, start the next round. The output is factored: P(class) P(token | class). A word outside the
network's tokens has P(other) times its add-half share of the training counts of such words.

Scoring runs over whole documents, all of a buffer in step, with the state carried from window to window. Words with at
least 1 / HEAVY of all training tokens (so HEAVY at most, of at most 64 characters) are known to every worker; the
counts of all rarer words come by a join on their 64-bit hashes.

Defined cases: a null text counts as empty and has its end token alone; a null doc_id is trained on and not held out;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored; very long texts
are trained on and scored whole, window by window.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, forget, rows_of, texts

MODEL, CLASS = 1022, 32
HIDDEN, STEPS, LANES = 16, 24, 256
#: A block of tokens too small for WINDOWS windows of LANES lanes is laid out in fewer lanes.
WINDOWS = 64
ROUNDS, RATE = 4, 0.01
HEAVY, LONGEST = 200_000, 64
END, OTHER = 0, 1
#: Tokens that a worker scores together, or lays out together for training.
BUFFER = 4_000_000


def words_of(text: str) -> list[bytes]:
    """In UTF-8. Of bytes, lower() changes A-Z only and split() parts at space and 0x09 to 0x0D only."""
    return text.encode().lower().split()


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w) - (1 << 63)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _picked(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each row at one place. States lie within 1, so the logits need no shift unless weights are huge."""
    if a.max(initial=0) > 60:
        a -= a.max(axis=1, keepdims=True)
    own = a[np.arange(len(a)), at]
    np.exp(a, out=a)
    return own - np.log(a @ np.ones(a.shape[1], np.float32))


def _soft(a: np.ndarray, every: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax of each row, in place; returns that of each row at one place."""
    if a.max(initial=0) > 60:
        a -= a.max(axis=1, keepdims=True)
    np.exp(a, out=a)
    a /= (a @ np.ones(a.shape[1], a.dtype))[:, None]
    return a[every, at]


class Gru:
    """Tokens 0 .. size - 1 in classes of CLASS neighbours."""

    def __init__(self, size: int, counts: np.ndarray, seed: int = 1):
        r, h = np.random.default_rng(seed), HIDDEN
        self.size, self.classes = size, -(-size // CLASS)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        share = np.zeros(self.classes * CLASS)
        share[:size] = counts + 0.5
        share = share.reshape(self.classes, CLASS)
        with np.errstate(divide="ignore"):
            inner = np.log(share / share.sum(axis=1, keepdims=True))
        self.p = {
            "e": f(size, h), "wx": f(h, 3 * h), "wh": f(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "wc": f(h, self.classes), "bc": np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
            "wo": f(self.classes, h, CLASS), "bo": np.maximum(inner, -30).astype(np.float32),
        }
        self.p["bo"][np.isneginf(inner)] = -1e9

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """x: the tokens' input products (n, 3h)."""
        p, k = self.p, HIDDEN
        hw = h @ p["wh"]
        zr = _sigmoid(x[:, : 2 * k] + hw[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        g = np.tanh(x[:, 2 * k :] + r * hw[:, 2 * k :])
        return h + z * (g - h), z, r, g, hw[:, 2 * k :]

    def advance(self, table: np.ndarray, last: np.ndarray, h: np.ndarray) -> None:
        """step() in place, for scoring. h: (HIDDEN, n), so that each gate is one stretch of memory."""
        k = HIDDEN
        hw, x = self.p["wh"].T @ h, table[last].T
        zr = hw[: 2 * k]
        zr += x[: 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        g = hw[2 * k :]
        g *= zr[k:]
        g += x[2 * k :]
        np.tanh(g, out=g)
        g -= h
        g *= zr[:k]
        h += g

    def inputs(self) -> np.ndarray:
        return self.p["e"] @ self.p["wx"] + self.p["b"]

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs of the targets' probabilities."""
        p = self.p
        cls = target // CLASS
        order = np.argsort(cls.astype(np.int16), kind="stable")
        h, cls = h[order], cls[order]
        within = target[order] - cls * CLASS
        edge = np.searchsorted(cls, np.arange(self.classes + 1))
        own = _picked(h @ p["wc"] + p["bc"], cls)
        for c in range(self.classes):
            if (i := edge[c]) < (j := edge[c + 1]):
                own[i:j] += _picked(h[i:j] @ p["wo"][c] + p["bo"][c], within[i:j])
        out = np.empty(len(h), np.float32)
        out[order] = own
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each document (token arrays, END last); END also comes before the first token."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        length = np.array([len(docs[i]) for i in order])
        flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.zeros(0, np.int64)
        start, table = np.cumsum(length) - length, self.inputs()
        h, total = np.zeros((HIDDEN, len(docs)), np.float32), np.zeros(len(docs))
        last, live = np.full(len(docs), END, np.int64), len(docs)
        held: list[tuple] = []
        n = 0
        for t in range(int(length[0]) if len(docs) else 0):
            if length[live - 1] <= t:
                live = int(np.searchsorted(-length, -t, side="left"))
                h, last = np.ascontiguousarray(h[:, :live]), last[:live]
            self.advance(table, last, h)
            last = flat[start[:live] + t].astype(np.int64)
            held.append((h.T.copy(), last, live))
            n += live
            if n >= 8192:
                self._gather(held, total)
                held, n = [], 0
        self._gather(held, total)
        out = np.empty(len(docs))
        out[order] = total
        return out

    def _gather(self, held: list[tuple], total: np.ndarray) -> None:
        if held:
            got, at = self.log_probs(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])), 0
            for _, _, live in held:
                total[:live] += got[at : at + live]
                at += live

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, grad: dict | None = None) -> tuple[dict, np.ndarray, float]:
        """Gradients over one window of (steps, lanes), the state after it, and the loss a token. grad: zeros to add them to."""
        p, k, n = self.p, HIDDEN, x.size
        grad = {name: np.zeros_like(v) for name, v in p.items()} if grad is None else grad
        at, kind = x.ravel(), p["wh"].dtype
        e = p["e"][at]
        x3 = (e @ p["wx"] + p["b"]).reshape(*x.shape, 3 * k)
        live = (~fresh)[:, :, None].astype(kind)
        h0s, zs, rs, gs, hns, hs = (np.empty((*x.shape, k), kind) for _ in range(6))
        for t in range(len(x)):
            h0 = np.multiply(h, live[t], out=h0s[t])
            hw, xt, g = h0 @ p["wh"], x3[t], gs[t]
            zr = hw[:, : 2 * k]
            zr += xt[:, : 2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            zs[t], rs[t], hns[t] = zr[:, :k], zr[:, k:], hw[:, 2 * k :]
            np.multiply(rs[t], hns[t], out=g)
            g += xt[:, 2 * k :]
            np.tanh(g, out=g)
            h = np.subtract(g, h0, out=hs[t])
            h *= zs[t]
            h += h0
        # rows in the order of their classes, so that each class is one stretch
        order = np.argsort((y.ravel() // CLASS).astype(np.int16), kind="stable")
        target, flat, every = y.ravel()[order], hs.reshape(n, k)[order], np.arange(n)
        cls, within = np.divmod(target, CLASS)
        a = flat @ p["wc"]
        a += p["bc"]
        own = _soft(a, every, cls)
        a[every, cls] -= 1
        a /= n
        grad["wc"] += flat.T @ a
        grad["bc"] += np.ones(n, kind) @ a
        dh = a @ p["wc"].T
        there, edge = np.unique(cls, return_index=True)
        spans = list(zip(there.tolist(), edge.tolist(), [*edge[1:].tolist(), n], strict=True))
        b = np.empty((n, CLASS), kind)
        for c, i, j in spans:
            np.matmul(flat[i:j], p["wo"][c], out=b[i:j])
            b[i:j] += p["bo"][c]
        own = own * _soft(b, every, within)
        b[every, within] -= 1
        b /= n
        for c, i, j in spans:
            part = b[i:j]
            grad["bo"][c] += np.ones(j - i, kind) @ part
            grad["wo"][c] += flat[i:j].T @ part
            dh[i:j] += part @ p["wo"][c].T
        back = np.empty_like(dh)
        back[order] = dh
        dh = back.reshape(*x.shape, k)
        # what does not depend on the later steps' gradient, for all steps at once
        to_g, to_z, to_r = zs * (1 - gs * gs), (gs - h0s) * zs * (1 - zs), hns * rs * (1 - rs)
        stay, wh = 1 - zs, np.ascontiguousarray(p["wh"].T)
        back, dx, dhw = np.zeros_like(h), np.empty((*x.shape, 3 * k), dh.dtype), np.empty((*x.shape, 3 * k), dh.dtype)
        for t in reversed(range(len(x))):
            d, u, v = dh[t] + back, dx[t], dhw[t]
            dg = d * to_g[t]
            u[:, :k] = d * to_z[t]
            u[:, k : 2 * k] = dg * to_r[t]
            u[:, 2 * k :] = dg
            v[:, : 2 * k] = u[:, : 2 * k]
            v[:, 2 * k :] = dg * rs[t]
            back = (d * stay[t] + v @ wh) * live[t]
        grad["wh"] += h0s.reshape(n, k).T @ dhw.reshape(n, 3 * k)
        flat, order = dx.reshape(n, 3 * k), np.argsort(at, kind="stable")
        grad["wx"] += e.T @ flat
        grad["b"] += flat.sum(axis=0)
        there, edge = np.unique(at[order], return_index=True)
        grad["e"][there] += np.add.reduceat((flat @ p["wx"].T)[order], edge, axis=0)
        return grad, h, float(-np.log(own + 1e-30).mean())

    def train(self, docs: Iterable[np.ndarray], rate: float = RATE) -> tuple[int, float]:
        """Adam over windows, once over all documents (token arrays, END last); returns the tokens and the loss a token."""
        names, sizes = list(self.p), [v.size for v in self.p.values()]
        flat = np.concatenate([v.ravel() for v in self.p.values()])
        cuts = np.cumsum(sizes)[:-1]
        views = lambda a: {k: v.reshape(self.p[k].shape) for k, v in zip(names, np.split(a, cuts), strict=True)}
        g, m, s, work = (np.zeros_like(flat) for _ in range(4))
        self.p, grad = views(flat), views(g)
        step, tokens, lost = 0, 0, 0.0
        for x, y, fresh in _lanes(docs):
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for i in range(0, len(x), STEPS):
                g[:] = 0
                _, h, loss = self.window(x[i : i + STEPS], y[i : i + STEPS], fresh[i : i + STEPS], h, grad)
                n = x[i : i + STEPS].size
                step, tokens, lost = step + 1, tokens + n, lost + loss * n
                g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
                # m += 0.1 (g - m); s += 0.01 (g g - s); then the step itself
                np.multiply(g, g, out=work)
                m *= 0.9
                g *= 0.1
                m += g
                s *= 0.99
                work *= 0.01
                s += work
                np.multiply(s, 1 / (1 - 0.99**step), out=work)
                np.sqrt(work, out=work)
                work += 1e-6
                np.divide(m, work, out=work)
                work *= rate / (1 - 0.9**step)
                flat -= work
        return tokens, lost / max(tokens, 1)


def _lanes(docs: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, the ones before them and where documents begin, side by side: (steps, lanes) for about BUFFER tokens at a
    time. The last lane is filled up with the block's first tokens, so none is left out."""

    def out(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.concatenate(held)
        first = np.zeros(len(y), bool)
        first[np.cumsum([0, *map(len, held[:-1])])] = True
        x = np.concatenate([[END], y[:-1]])
        lanes = max(1, min(LANES, len(y) // (STEPS * WINDOWS)))
        n = -(-len(y) // lanes)
        y, x, fresh = (np.ascontiguousarray(np.resize(v, n * lanes).reshape(lanes, n).T) for v in (y, x, first))
        return x.astype(np.int32), y.astype(np.int32), fresh

    held, size = [], 0
    for d in docs:
        held.append(d)
        size += len(d)
        if size >= BUFFER:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def count_words(rows: DataFrame) -> DataFrame:
    """word, hash and c over all rows' texts; tasks add up before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(map(word_hash, c)), pa.int64()), pa.array(list(c.values()), pa.int64())], ["word", "hash", "c"])

        held: Counter = Counter()
        for b in rows_of(batches):
            for t in b["text"].to_pylist():
                held.update(words_of(t))
            if len(held) > 400_000:
                yield out(held)
                held = Counter()
        yield out(held)

    return rows.select("text").mapInArrow(run, "word string, hash long, c long").groupBy("word", "hash").agg(F.sum("c").alias("c"))


def encoded(training: DataFrame, words: list[bytes]) -> DataFrame:
    """round, and tokens of every row: the network's, as 16-bit integers, END last; written once, in a folder a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = {w: i + 2 for i, w in enumerate(words)}, 0
        for b in rows_of(batches):
            rows = [words_of(t) for t in b["text"].to_pylist()]
            turn = np.arange(seen, seen + len(rows)) % ROUNDS
            seen += len(rows)
            tokens = [np.array([*(at.get(w, OTHER) for w in r), END], "<i2").tobytes() for r in rows]
            yield pa.record_batch([pa.array(turn, pa.int32()), pa.array(tokens, pa.binary())], ["round", "tokens"])

    return cut(training.select("text").mapInArrow(run, "round int, tokens binary"), "tokens", "round")


def trained(gru: Gru, tokens: DataFrame) -> list[int]:
    """Train gru in place on all rows of tokens (round, tokens), each once; returns the number of tokens, then each round's."""
    spark, seen = tokens.sparkSession, []
    shapes = {k: v.shape for k, v in gru.p.items()}
    schema = "part long, n long, weights binary"

    def sums(rows: list) -> tuple[int, np.ndarray]:
        """Tokens and weights * tokens, added up in the order of their parts."""
        total, n = 0.0, 0
        for _, k, w in sorted(rows, key=lambda r: r[:2]):
            total, n = total + np.frombuffer(w, np.float64), n + k
        return n, total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [tuple(r.values()) for b in batches for r in b.to_pylist()]:
            n, total = sums(rows)
            yield pa.record_batch([pa.array([min(r[0] for r in rows)], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "weights"])

    for turn in range(ROUNDS):
        given = spark.sparkContext.broadcast(gru)
        rate = RATE * (1 - 0.9 * turn / ROUNDS)
        now = tokens.filter(F.col("round") == turn).select("tokens")
        groups = math.isqrt(max(1, now.rdd.getNumPartitions())) + 1

        def fit(batches: Iterator[pa.RecordBatch], given=given, rate=rate) -> Iterator[pa.RecordBatch]:
            own = copy.deepcopy(given.value)
            n, _ = own.train((np.frombuffer(t, "<i2") for b in batches for t in b["tokens"].to_pylist()), rate)
            if n:
                w = np.concatenate([v.ravel() for v in own.p.values()]).astype(np.float64) * n
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["part", "n", "weights"])

        # means of about sqrt(partitions) partitions each, so that few weights reach the driver
        got = now.mapInArrow(fit, schema).repartition(groups).mapInArrow(add, schema).collect()
        given.destroy()
        if not got:
            continue
        n, total = sums([tuple(r) for r in got])
        flat, at = (total / n).astype(np.float32), 0
        for k, shape in shapes.items():
            size = math.prod(shape)
            gru.p[k] = flat[at : at + size].reshape(shape)
            at += size
        seen.append(n)
    return [sum(seen), *seen]


def learn(counts: DataFrame, training: DataFrame) -> dict:
    """What workers need: heavy words with log10(c + 0.5), the network, and the corpus's sums."""
    n_docs = training.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, types = total + n_docs, distinct + (n_docs > 0)
    heavy = counts.filter((F.col("c") >= tokens / HEAVY) & (F.length("word") <= LONGEST)).select("word", "c").toArrow().to_pydict()
    ranked = sorted(zip(heavy["word"], heavy["c"], strict=True), key=lambda x: (-x[1], x[0]))
    words, c = [w.encode() for w, _ in ranked], np.array([n for _, n in ranked], np.int64)
    inside = min(MODEL, len(words))
    rest = int(total - c[:inside].sum())
    gru = Gru(inside + 2, np.concatenate([[n_docs, rest], c[:inside]]))
    written = encoded(training, words[:inside])
    trained(gru, written)
    forget(written)
    other = np.log10(rest + 0.5 * (distinct - inside + 1))
    return {"words": words, "log_c": np.log10(c + 0.5), "inside": inside, "gru": gru, "tokens": int(tokens), "types": int(types), "ends": int(n_docs), "other": float(other)}


def score(docs: DataFrame, training: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    counts = counts if counts is not None else cut(count_words(training), "words")
    model = learn(counts, training)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, row = spread.value, TaskContext.get().partitionId() << 40, 0
        index = {w: i for i, w in enumerate(m["words"])}
        log_c = np.append(m["log_c"], 0.0)
        held, seqs, size = [], [], 0

        def out() -> pa.RecordBatch:
            got = m["gru"].score(seqs) / np.log(10)
            rows = [{**r, "net": float(g)} for r, g in zip(held, got, strict=True)]
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("heavy", pa.float64()), ("other", pa.float64()), ("n_other", pa.int64()), ("net", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
        for b in rows_of(batches):
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = words_of(t)
                ids = np.array([index.get(w, -1) for w in words], np.int64)
                rare = Counter(word_hash(words[j]) for j in np.flatnonzero(ids < 0).tolist())
                outside = ids >= m["inside"]
                seq = np.where((ids >= 0) & ~outside, ids + 2, OTHER)
                held.append({"row": part + row, "doc_id": i, "n_tokens": len(words) + 1, "n_known": int((ids >= 0).sum()) + (m["ends"] > 0), "heavy": float(log_c[ids].sum()), "other": float(log_c[ids[outside]].sum()), "n_other": int((seq == OTHER).sum()), "rare": list(rare), "times": list(rare.values())})
                seqs.append(np.append(seq, END).astype(np.int16))
                row, size = row + 1, size + len(words) + 1
                if size >= BUFFER:
                    yield out()
                    held, seqs, size = [], [], 0
        if held:
            yield out()

    schema = "row long, doc_id long, n_tokens long, n_known long, heavy double, other double, n_other long, net double, rare array<long>, times array<int>"
    rows = cut(docs.select("doc_id", "text").mapInArrow(run, schema), "scored")
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    rare = counts.filter((F.col("c") < model["tokens"] / HEAVY) | (F.length("word") > LONGEST)).select("hash", "c")
    met = pairs.join(rare, "hash", "left")
    per = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    both = rows.drop("rare", "times").join(per, "row", "left")
    rare_sum, n = F.coalesce("rare_sum", F.lit(0.0)), F.lit(model["tokens"]).cast("long")
    end = float(np.log10(model["ends"] + 0.5))
    base = F.col("heavy") + rare_sum + end - F.col("n_tokens") * float(np.log10(model["tokens"] + 0.5 * (model["types"] + 1)))
    return both.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), n.alias("train_tokens"), base.alias("base_score"),
        (F.col("net") + F.col("other") + rare_sum - F.col("n_other") * model["other"]).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    rows = texts(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    got = score(rows, rows.filter(~held_out))
    return got.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
