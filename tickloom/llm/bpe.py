"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie one after another in one array of symbols. An index maps each pair of neighbours
to all its positions; the active ranks are taken in ascending order from a heap, all positions of the pair are merged,
and the lists of the pairs that this makes are updated. Words already encoded are kept by the worker, up to KEPT_BYTES.

Reads the file of a public tokenizer (kind: BPE with word ends over byte-level pieces; NFC, white space, lower case).
Text may be split at spaces and line feeds beforehand, as no piece goes over white space.

Defined cases: a null text counts as empty and has no tokens; a null doc_id stays; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored. Ids come from whole texts of any length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tickloom.llm.common import lean, only, rows_of, texts, worker_cache

VOCABULARY = "word_bpe_49k.json"
#: Bytes, about, of the chunks and ids that a worker keeps.
KEPT_BYTES = 48 << 20
#: New chunks encoded together.
PART = 10_000
#: Bytes of text handled together.
PIECE_BYTES = 1 << 20
_loaded: dict[str, object] = worker_cache()


def byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte: itself if printable, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Words:
    """Ids of the chunks of texts that a space or line feed ends. The ids of known chunks lie one after another in one
    array, and the chunks themselves in an Arrow array, as objects of Python's would take several times as much; what is
    new in a batch is encoded together. Over `most` bytes, only what the current batch has stays."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = KEPT_BYTES):
        """encode_new: chunks -> (all their ids, number of ids of each)."""
        self.encode_new, self.most = encode_new, most
        self.chunks = pa.array([], pa.string())
        self.flat, self.start, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def ids(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch's texts (null: empty), and the number of ids of each."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(batch, ""), "\n", " "), " ")
        found = pc.dictionary_encode(split.flatten())
        place = self.places(found.dictionary)
        flat, each = self.of(place[found.indices.to_numpy(zero_copy_only=False)])
        ends = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        return flat, np.diff(ends[np.concatenate([[0], last])])

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where each of the chunks (distinct) is; unknown ones are encoded first. Holds until the next call."""
        chunks = chunks.cast(pa.string())
        place = pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh := np.flatnonzero(place < 0)):
            new = chunks.take(pa.array(fresh))
            if self.used + _size(new) > self.most and len(self.chunks):
                stay = np.flatnonzero(place >= 0)
                flat, sizes = self.of(place[stay])
                self.chunks, self.used = self.chunks[:0], 0
                self.start[0] = 0
                place[stay] = self._add(chunks.take(pa.array(stay)), flat, sizes)
            for i in range(0, len(new), PART):
                part = new[i : i + PART]
                place[fresh[i : i + PART]] = self._add(part, *self.encode_new(part.to_pylist()))
        return place

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids at the places, and the number of each."""
        sizes = self.start[place + 1] - self.start[place]
        return self._gather(place, sizes), sizes

    def _add(self, chunks: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, at = len(self.chunks), int(self.start[len(self.chunks)])
        self.start = _room(self.start, n + len(chunks) + 1)
        self.flat = _room(self.flat, at + len(flat))
        self.start[n + 1 : n + len(chunks) + 1] = at + np.cumsum(sizes)
        self.flat[at : at + len(flat)] = flat
        self.chunks = pa.concat_arrays([self.chunks, chunks])
        self.used += _size(chunks) + 4 * len(flat)
        return np.arange(n, n + len(chunks))

    def _gather(self, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.start[place] - before, sizes) + np.arange(int(sizes.sum()))]


def _size(chunks: pa.Array) -> int:
    """With what finds them: an offset, a place and an entry of the table that index_in() makes for each."""
    return chunks.nbytes + 40 * len(chunks)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | added).items()}
        self.added = added
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.rules = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b, _) in enumerate(self.rules):
            self.rank.setdefault((a, b), r)
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        letters = byte_letters()
        # ids of the bytes, and of the bytes at a word's end; ranks of their pairs
        self.letters = np.array([self.vocab[c] for c in letters] + [self.vocab[c + self.end] for c in letters], np.int64)
        code = {int(x): i for i, x in enumerate(self.letters)}
        self.letter_ranks = np.full((512, 512), -1, np.int64)
        for (x, y), r in self.rank.items():
            if x in code and y in code:
                self.letter_ranks[code[x], code[y]] = r
        self.known = Words(self._merged, KEPT_BYTES // 2)
        self.words = Words(self.encode_chunks, KEPT_BYTES // 2)

    def pieces(self, chunk: str) -> list[str]:
        """The words that the model gets; a special token is a piece of its own, as an id."""
        if chunk.isascii():
            return self.pattern.findall(chunk.lower())
        return self.pattern.findall("".join(map(str.lower, unicodedata.normalize("NFC", chunk))) if "Σ" in chunk else unicodedata.normalize("NFC", chunk).lower())

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, and the number of ids of each."""
        split: list[list[str | int]] = []
        for c in chunks:
            if self.specials and "<|" in c:
                parts, at = [], 0
                for m in self.specials.finditer(c):
                    parts += [*self.pieces(c[at : m.start()]), self.added[m[0]]]
                    at = m.end()
                split.append(parts + self.pieces(c[at:]))
            else:
                split.append(self.pieces(c))
        seen = list({p for s in split for p in s if isinstance(p, str)})
        flat, sizes = self.known.of(self.known.places(pa.array(seen, pa.string())))
        ids, at = flat.tolist(), np.cumsum(sizes).tolist()
        merged: dict = {p: ids[j - n : j] for p, j, n in zip(seen, at, sizes.tolist(), strict=True)}
        merged |= {i: [i] for i in self.added.values()}
        sizes = np.fromiter((sum(len(merged[p]) for p in s) for s in split), np.int64, len(split))
        return np.fromiter(chain.from_iterable(merged[p] for s in split for p in s), np.uint32, int(sizes.sum())), sizes

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.merge(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (none is empty)."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        code = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        code[bounds[1:] - 1] += 256
        here = np.arange(len(code))
        to, back = here + 1, here - 1
        to[bounds[1:] - 1] = -1
        back[bounds[:-1]] = -1
        symbol, before, after = self.letters[code].tolist(), back.tolist(), to.tolist()
        # the index of the letters' own pairs
        ranks = self.letter_ranks[code[:-1], code[1:]] if len(code) else np.zeros(0, np.int64)
        at = np.flatnonzero((ranks >= 0) & (to[:-1] > 0))
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first = np.unique(ranks[at], return_index=True)
        cuts, at = [*first.tolist(), len(at)], at.tolist()
        index = {r: at[i:j] for r, i, j in zip(found.tolist(), cuts[:-1], cuts[1:], strict=True)}
        rank = self.rank
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.rules[r]
            at = index.pop(r)
            if a == b:
                at.sort()  # aaa is merged from the left
            for i in at:
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue
                k, h = after[j], before[i]
                symbol[i], symbol[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    if (q := rank.get((new, symbol[k]))) is not None:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(i)
                if h >= 0 and (q := rank.get((symbol[h], new))) is not None:
                    if q not in index:
                        index[q] = []
                        heapq.heappush(active, q)
                    index[q].append(h)
        cuts = bounds.tolist()
        return [[x for x in symbol[i:j] if x >= 0] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_batch(self, batch: Iterable[str | None]) -> Iterator[list[int]]:
        flat, sizes = self.words.ids(pa.array(batch, pa.string()))
        ids, at = flat.tolist(), 0
        for n in sizes.tolist():
            yield ids[at : at + n]
            at += n

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


def load(path: str) -> Bpe:
    only(_loaded)
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(public_tokenizers.path(vocabulary))
        for b in rows_of(lean(batches), PIECE_BYTES):
            flat, sizes = bpe.words.ids(b["text"])
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.record_batch([b["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32)))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(public_tokenizers.path(vocabulary))
        for b in rows_of(lean(batches), PIECE_BYTES):
            yield pa.record_batch([b["doc_id"], pa.array([bpe.decode(x or ()) for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document the number of its ids, the hash of their decimals, and the hash of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(public_tokenizers.path(vocabulary))
        decimal = {i: str(i) for i in bpe.tokens}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in rows_of(lean(batches), PIECE_BYTES):
            n, ids, back = [], [], []
            for x in bpe.encode_batch(b["text"]):
                n.append(len(x))
                ids.append(sha(" ".join(map(decimal.__getitem__, x))))
                back.append(sha(bpe.decode(x)))
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
