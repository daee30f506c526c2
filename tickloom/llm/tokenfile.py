"""Token-id files: fixed-size blocks of ids, transposed to bit or byte planes, each plane compressed with zstandard.

File: MAGIC, the blocks' planes one after another, then an index (JSON, zstandard) of the blocks (offset, ids, bytes of
each plane) and of the documents (doc_id, ids), the index's length (8 bytes, little endian) and MAGIC. Any block can be
read by itself.

Documents are dealt out by ranges of doc_id; each task writes files of about SHARD ids under a temporary name and
moves them to a name that follows from the partition and the file's number, so that a task that runs again writes the
same files. The list of files is a table; offsets are running sums over it.

Defined cases: a null text counts as empty (its end id alone); null doc_ids come first; rows with one doc_id follow
each other in the order of their texts; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.bpe import KEPT_BYTES, Words, byte_letters
from tickloom.llm.common import cut, only, partitions, rows_of, scratch, texts, worker_cache

MAGIC = b"TLPLANE1"
BLOCK, SHARD = 1 << 16, 1 << 22
VOCABULARY, END = "word_bpe_49k.json", 1
LEVEL = 1
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]+)?")
TOGETHER = 2000
_library: dict[str, Words] = worker_cache()


def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The ids' 4 byte planes, or 32 bit planes, low first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, i].tobytes() for i in range(4)]
    b = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(b[:, i]).tobytes() for i in range(32)]


def unplanes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1).reshape(-1).view("<u4")
    b = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], axis=1)
    return np.packbits(b, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int], bits: bool = False) -> bytes:
    c = zstandard.ZstdCompressor(level=LEVEL)
    out, index, at = [MAGIC], [], len(MAGIC)
    for i in range(0, len(ids), BLOCK):
        part = ids[i : i + BLOCK]
        done = [c.compress(p) if p.strip(b"\0") else b"" for p in planes(part, bits)]
        index.append([at, len(part), [len(p) for p in done]])
        at += sum(map(len, done))
        out += done
    foot = c.compress(json.dumps({"bits": bits, "blocks": index, "docs": doc_ids, "sizes": sizes}).encode())
    return b"".join([*out, foot, len(foot).to_bytes(8, "little"), MAGIC])


class Reader:
    """A file's index; ids by block, or all."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token-id file")
        n = int.from_bytes(data[-16:-8], "little")
        foot = json.loads(zstandard.ZstdDecompressor().decompress(data[-16 - n : -16]))
        self.data, self.bits, self.blocks, self.docs, self.sizes = data, foot["bits"], foot["blocks"], foot["docs"], foot["sizes"]

    def block(self, k: int) -> np.ndarray:
        at, n, lengths = self.blocks[k]
        d, parts, empty = zstandard.ZstdDecompressor(), [], bytes(-(-n // 8) if self.bits else n)
        for size in lengths:
            parts.append(d.decompress(self.data[at : at + size]) if size else empty)
            at += size
        return unplanes(parts, n)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.blocks))]) if self.blocks else np.zeros(0, "<u4")


def library(path: str) -> Words:
    """The tokenizers library's ids of chunks of text that a space or line feed ends.

    A chunk of Latin letters and final punctuation is one or two of the pre-tokenizer's words: these go to the library's
    model in lower case, with bytes as the byte-level letters, TOGETHER at a time, and a token that ends a word tells
    where the next one begins. The whole of the library's tokenizer encodes all other chunks.
    """
    only(_library)
    if path not in _library:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole, model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        model.normalizer = model.pre_tokenizer = None
        suffix, vocabulary = model.model.end_of_word_suffix, model.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        letters = byte_letters()
        table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            words, owner, others = [], [], []
            for i, c in enumerate(chunks):
                if m := PLAIN.fullmatch(c):
                    word, mark = m.groups()
                    word = word.lower()
                    words.append(word if word.isascii() else word.translate(table))
                    owner.append(i)
                    if mark:
                        words.append(mark)
                        owner.append(i)
                else:
                    others.append(i)
            batches = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
            ids = [np.array(e.ids, np.uint32) for e in model.encode_batch_fast(batches, is_pretokenized=True, add_special_tokens=False)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            whose = np.array(owner, np.int64)[np.cumsum(ends[flat]) - ends[flat]]
            rest = [e.ids for e in whole.encode_batch_fast([chunks[i] for i in others], add_special_tokens=False)]
            whose = np.concatenate([whose, np.repeat(np.array(others, np.int64), [len(x) for x in rest])])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(rest), np.uint32)])
            return flat[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(chunks))

        _library[path] = Words(encode, KEPT_BYTES)
    return _library[path]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a URI, and the path there; Hadoop's names for S3 are those of S3."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, bits: bool = False) -> DataFrame:
    """Writes token-id files to folder; returns the table of files: uri, part, seq, n_docs, n_ids, start (ids of all files before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = library(public_tokenizers.path(vocabulary)), TaskContext.get().partitionId()
        store, base = _store(folder)
        ids, names, sizes, seq = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/ids-{part:06d}-{seq:06d}.tlp"
            store.create_dir(base, recursive=True)
            data = pack(np.concatenate(ids), names, sizes, bits)
            try:
                with store.open_output_stream(tmp := f"{name}.{uuid.uuid4().hex}") as f:
                    f.write(data)
                store.move(tmp, name)
            except Exception:
                if store.get_file_info(tmp).type != fs.FileType.NotFound:
                    store.delete_file(tmp)
                raise
            return pa.record_batch([pa.array([f"{folder}/ids-{part:06d}-{seq:06d}.tlp"]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["uri", "part", "seq", "n_docs", "n_ids"])

        held = 0
        for b in rows_of(batches):
            flat, each = words.ids(b["text"])
            ids.append(np.insert(flat, np.cumsum(each), end))
            names += b["doc_id"].to_pylist()
            sizes += (each + 1).tolist()
            held += len(ids[-1])
            if held >= SHARD:
                yield flush()
                ids, names, sizes, seq, held = [], [], [], seq + 1, 0
        if names:
            yield flush()

    t = texts(docs).repartitionByRange(4 * partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = t.mapInArrow(run, "uri string, part int, seq int, n_docs long, n_ids long")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    # one task writes the table: Hadoop's local file system starts a process for each file, and such a process counts
    # as another copy of its executor until it becomes chmod
    return cut(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b["uri"].to_pylist(), b["start"].to_pylist(), strict=True):
                store, path = _store(uri)
                with store.open_input_stream(path) as f:
                    r = Reader(f.read())
                sizes = np.array(r.sizes, np.int64)
                at, raw = np.concatenate([[0], np.cumsum(sizes)]), memoryview(r.ids().tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(r.docs, pa.int64()), pa.array(start + at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("uri", "start").repartition(partitions(files.sparkSession))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    return read(write(docs, scratch(docs.sparkSession, "ids")))
