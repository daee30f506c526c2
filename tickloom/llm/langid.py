"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, from any position, the longest match in that language's
text. A text is parsed greedily into such phrases; a language's cost is phrases * log2(length of its labelled text) a
character, and the language with the least cost wins (ties: the smaller code point).

The labelled text is a bounded sample (`sample_docs` whole documents and about `sample_chars` characters a language);
the prediction reads whole texts. An automaton knows all letters of its own labelled text: transitions by its LETTERS
most frequent ones are a dense table, those by the rest sorted keys. Many stretches of STRETCH characters are parsed in
step, so Python runs once a column of characters and not once a character. Then the phrase that a stretch ends in goes
on into the next one until a phrase begins where that one's own parse has one begin; from there on both are the same.
So the phrases are those of the whole text, however long.

Defined cases: null texts, and texts without a letter, are `und` with score 0; without labelled text every text is
`und`; a null lang or doc_id is not learned from; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored; clashing names do no harm, as only positions and chosen columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import lean, only, rows_of, small_batches, worker_cache

UNKNOWN = "und"
STRETCH = 512
#: Letters of a language whose transitions are a dense table. Code 0 is the space between words.
LETTERS = 62
_folded: np.ndarray | None = None
_built: dict[int, tuple] = worker_cache()


def folded() -> np.ndarray:
    """For each code point its letter in lower case, or 0 if it is none."""
    global _folded
    if _folded is None:
        _folded = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                _folded[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return _folded


def plain(text: str) -> np.ndarray:
    """The text's letters in lower case, with one 0 for each run of other characters between them."""
    x = folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    x = x[(x != 0) | (np.concatenate([[0], x[:-1]]) != 0)]
    return x[:-1] if len(x) and x[-1] == 0 else x


def states(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of codes; state 1 is the start, 0 says no match."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, size, last = [0, 0], [0, 0], 1
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        size.append(size[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton's transitions by codes under width, flat: row 1 is the start, 0 says no match."""
    return dense(states(codes), width)


def dense(nxt: list[dict[int, int]], width: int) -> np.ndarray:
    table = np.zeros(len(nxt) * width, np.int32)
    for s, row in enumerate(nxt):
        for c, to in row.items():
            if c < width:
                table[s * width + c] = to
    return table


def sparse(nxt: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The transitions by the other codes: sorted keys (state << 32 | code), and where they lead."""
    found = sorted((s << 32 | c, to) for s, row in enumerate(nxt) for c, to in row.items() if c >= width)
    return np.array([k for k, _ in found], np.int64), np.array([to for _, to in found], np.int32)


def _both(codes: np.ndarray, width: int) -> tuple:
    """dense(), width and sparse(); the states themselves go before the next language's are made."""
    nxt = states(codes)
    return dense(nxt, width), width, sparse(nxt, width)


def build(samples: dict[str, str]) -> tuple:
    """(languages, class of each code point, [(transitions, width, rare transitions, code of each class, bits a phrase)]).

    Classes are 0, the letters of any sample, and one for all other letters. A language's codes are 0, its most frequent
    letters, width - 1 for letters that it does not have, and its rarer letters from width on.
    """
    parts = {k: plain(v) for k, v in sorted(samples.items())}
    parts = {k: v for k, v in parts.items() if len(v)}
    known = np.unique(np.concatenate([np.zeros(1, np.uint32), *parts.values()]))
    classes = np.full(0x110000, len(known), np.min_scalar_type(len(known)))
    classes[known] = np.arange(len(known))
    tables = []
    for v in parts.values():
        own = classes[v]
        count = np.bincount(own, minlength=len(known) + 1)
        count[0] = 0
        letters = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        width = min(len(letters), LETTERS) + 2
        code = np.full(len(known) + 1, width - 1, np.int32)
        code[0] = 0
        code[letters] = np.arange(1, len(letters) + 1) + (np.arange(len(letters)) >= LETTERS)
        tables.append((*_both(code[own], width), code, float(np.log2(len(v) + 1))))
    return list(parts), classes, tables


def _next(table: np.ndarray, width: int, rare: tuple | None, state: np.ndarray | int, c: np.ndarray) -> np.ndarray:
    if rare is None:
        return table[state * width + c]
    to = table[state * width + np.minimum(c, width - 1)]
    if len(at := np.flatnonzero(c >= width)):
        keys = (np.broadcast_to(state, len(c))[at].astype(np.int64) << 32) | c[at]
        place = np.minimum(np.searchsorted(rare[0], keys), len(rare[0]) - 1)
        to[at] = np.where(rare[0][place] == keys, rare[1][place], 0)
    return to


def phrases(table: np.ndarray, width: int, codes: np.ndarray, start: np.ndarray, length: np.ndarray, rare: tuple | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """Phrases that begin in each stretch codes[start : start + length]; the stretches come longest first. rare: as of
    sparse(). before: of each stretch the one whose last phrase goes on into it, -1 if a phrase begins with it."""
    rare = rare if rare is not None and len(rare[0]) else None
    begins = np.zeros(len(codes), bool)
    begins[start] = True
    state = np.ones(len(start), np.int32)
    live = len(start)

    def step(now: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the characters at `at`, and which of these begin a phrase."""
        c = codes[at]
        to = _next(table, width, rare, now, c)
        if len(broken := np.flatnonzero(to == 0)):
            again = _next(table, width, rare, 1, c[broken])
            to[broken] = np.where(again == 0, 1, again)
        return to, broken

    for j in range(int(length[0]) if len(length) else 0):
        while live and length[live - 1] <= j:
            live -= 1
        at = start[:live] + j
        state[:live], broken = step(state[:live], at)
        begins[at[broken]] = True
    run = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])
    count = run[start + length] - run[start]
    own = state.copy()
    redo = np.flatnonzero(before >= 0) if before is not None else np.zeros(0, np.int64)
    while len(redo):
        lane, now, new, changed = redo, state[before[redo]], np.zeros(len(redo), np.int64), []
        at, end = start[redo].copy(), start[redo] + length[redo]
        while len(lane):
            now, broken = step(now, at)
            new[broken] += 1
            met = np.zeros(len(lane), bool)
            met[broken] = begins[at[broken]]
            count[lane[met]] = new[met] + run[end[met]] - run[at[met] + 1]
            at = at + 1
            over = ~met & (at == end)
            count[lane[over]] = new[over]
            for ended, last in ((lane[met], own[lane[met]]), (lane[over], now[over])):
                changed.append(ended[last != state[ended]])
                state[ended] = last
            go = ~(met | over)
            lane, now, new, at, end = lane[go], now[go], new[go], at[go], end[go]
        redo = np.flatnonzero(np.isin(before, np.concatenate(changed)))
    return count


def parse(model: tuple, batch: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits a character (of the winner; 0 without letters) of each text."""
    names, classes, tables = model
    parts = [plain(t) if t else np.zeros(0, np.uint32) for t in batch]
    n = np.array([len(p) for p in parts], np.int64)
    if not names or not n.any():
        return [UNKNOWN] * len(batch), [0.0] * len(batch), [0.0] * len(batch)
    seen = classes[np.concatenate(parts)]
    pieces = -(-n // STRETCH)
    doc = np.repeat(np.arange(len(batch)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(n) - n)[doc] + k * STRETCH
    length = np.minimum(STRETCH, n[doc] - k * STRETCH)
    order = np.argsort(-length, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    before = np.where(k[order] > 0, where[order - 1], -1)
    doc, start, length = doc[order], start[order], length[order]
    cost = np.stack([np.bincount(doc, phrases(t, width, code[seen], start, length, rare, before), len(batch)) * bits / np.maximum(n, 1) for t, width, rare, code, bits in tables])
    best = cost.argmin(axis=0)
    least = cost[best, np.arange(len(batch))]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (1 / least) / (1 / cost).sum(axis=0)
    lang = [names[b] if c else UNKNOWN for b, c in zip(best.tolist(), n.tolist(), strict=True)]
    return lang, np.where(n > 0, np.round(share, 6), 0.0).tolist(), np.where(n > 0, least, 0.0).tolist()


def learn(labelled: DataFrame, sample_docs: int = 150, sample_chars: int = 60_000) -> dict[str, str]:
    """Labelled text per language: whole documents, those of at most sample_chars / 10 characters first, in hash order.

    labelled: key, text, lang. At most sample_docs rows a language come to the driver, and of those the first that
    together reach sample_chars; Spark keeps the least sample_docs of each task before it moves rows.
    """
    order = Window.partitionBy("lang").orderBy(F.length("text") > sample_chars // 10, F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), "text")
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0 AND lang <> 'und'").select("key", "text", "lang")
    kept = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_docs)
    size = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("before", F.coalesce(size, F.lit(0))).filter(F.col("before") < sample_chars)
    out: dict[str, list[str]] = {}
    for r in kept.select("lang", "rank", "text").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v)) for k, v in out.items()}


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """docs' doc_id with lang_pred, score and bits (a character); the automata are built once a worker."""
    small_batches(docs.sparkSession)
    key, spread = hash(tuple(sorted(samples.items()))), docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in only(_built):
            _built.clear()
            _built[key] = build(spread.value)
        for b in rows_of(batches):
            lang, score, bits = parse(_built[key], b["text"].to_pylist())
            yield pa.record_batch([b["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("key"), "text", "lang")


def digest(docs: DataFrame) -> DataFrame:
    got = predict(docs, learn(training(docs)))
    return got.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, most_bits: float = 8.0) -> DataFrame:
    """The documents, all columns kept, without those that are rejected: no letters, or more bits a character than any
    of the languages would need for its own prose."""
    small_batches(docs.sparkSession)
    samples = learn(training(docs))
    key, spread = hash(tuple(sorted(samples.items()))), docs.sparkSession.sparkContext.broadcast(samples)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in only(_built):
            _built.clear()
            _built[key] = build(spread.value)
        for b in rows_of(lean(batches)):
            lang, _, bits = parse(_built[key], b.column(at).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and y <= most_bits for x, y in zip(lang, bits, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
