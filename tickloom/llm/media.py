"""Audio features of media columns: lossless 8-bit WAV, polyphase resampling, overlapped log-mel filterbanks and
hysteresis energy segmentation, kept as fixed-shape Arrow tensors with time spans.

A payload is the text's bytes in UTF-8, filled up with byte 255 to a positive multiple of 576, one byte a sample.
The samples are read back from the stored WAV bytes; everything else comes from those. Long payloads pass through
the filters in blocks, so memory is bounded by the text itself.

Defined cases: a null text counts as empty (one block of 576 fill bytes); a null doc_id stays; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored; a payload shorter than a frame is
filled with silence to one frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import rows_of, texts

RATE, UP, DOWN = 12_000, 2, 3
TAPS = 8
FRAME, HOP, MELS = 256, 128, 24
TENSOR = (8, MELS)
UNIT = 576
BLOCK = 4096


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF WAVE, PCM, one channel, 8 bits a sample."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def from_wav(wav: bytes) -> bytes:
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE")
    at = 12
    while at < len(wav):
        name, n = struct.unpack_from("<4sI", wav, at)
        if name == b"data":
            return wav[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@cache
def _phases() -> np.ndarray:
    """(UP, TAPS): windowed-sinc low-pass, split into one short filter for each output phase."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hanning(UP * TAPS + 2)[1:-1]
    h *= UP / h.sum()
    return h.reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at RATE to RATE * UP / DOWN: every output needs only the taps of its phase; no zeros are stuffed in."""
    n = -(-len(x) * UP // DOWN)
    out = np.zeros(n, np.float32)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    for m in range(min(UP, n)):  # outputs m, m + UP, ... share a phase; their inputs lie DOWN apart
        first, phase = m * DOWN // UP, m * DOWN % UP
        k = len(out[m::UP])
        for j in range(TAPS):
            at = first + TAPS - 1 - j
            part = padded[at : at + (k - 1) * DOWN + 1 : DOWN]
            out[m::UP][: len(part)] += _phases()[phase, j] * part
    return out


@cache
def _mel() -> np.ndarray:
    """(FRAME / 2 + 1, MELS) triangles, equally spaced in mel."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies by mel band, and the frames' log energies."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    win, bands, power = np.hanning(FRAME).astype(np.float32), [], []
    for i in range(0, len(view), BLOCK):
        part = view[i : i + BLOCK] * win
        spec = np.fft.rfft(part, axis=1)
        spec = (spec.real**2 + spec.imag**2).astype(np.float32)
        bands.append(np.log(np.einsum("ij,jk->ik", spec, _mel(), optimize=False) + 1e-6) if len(part) < 4 else np.log(spec @ _mel() + 1e-6))
        power.append(np.log((part * part).sum(axis=1) + 1e-6))
    return np.concatenate(bands), np.concatenate(power)


def segments(power: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that begin where the energy rises over the upper threshold and last until it falls under the lower one."""
    mid, spread = float(power.mean()), float(power.std())
    mark = np.where(power > mid + 0.25 * spread, 1, np.where(power < mid - 0.25 * spread, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(wav: bytes) -> pa.Table:
    """start_s, end_s and log_mel: a fixed_shape_tensor for each segment, its frames pooled to TENSOR."""
    x = (np.frombuffer(from_wav(wav), np.uint8).astype(np.float32) - 128) / 128
    bands, power = log_mel(resample(x))
    spans, step = segments(power), HOP / (RATE * UP / DOWN)
    data = np.zeros((len(spans), *TENSOR), np.float32)
    run = np.concatenate([np.zeros((1, MELS)), np.cumsum(bands, axis=0, dtype=np.float64)])
    for k, (a, b) in enumerate(spans):
        cuts = a + (np.arange(TENSOR[0] + 1) * (b - a)) // TENSOR[0]
        lo, hi = cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1)
        data[k] = (run[hi] - run[lo]) / (hi - lo)[:, None]
    kind = pa.fixed_shape_tensor(pa.float32(), TENSOR)
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), TENSOR[0] * TENSOR[1]))
    t = pa.table({"start_s": pa.array([a * step for a, _ in spans], pa.float64()), "end_s": pa.array([b * step for _, b in spans], pa.float64()), "log_mel": column})
    return t.replace_schema_metadata({"frames": str(len(power)), "mean": json.dumps([round(float(v), 3) for v in bands.mean(axis=0)])})


def stored(table: pa.Table) -> bytes:
    """The table as an Arrow stream, which keeps the tensor type."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        wavs = [to_wav(payload(t)) for t in b["text"].to_pylist()]
        sizes = [len((t or "").encode()) for t in b["text"].to_pylist()]
        arrow = [stored(tensors(w)) for w in wavs]
        yield pa.record_batch([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(wavs, pa.binary()), pa.array(arrow, pa.binary())], ["doc_id", "n_bytes", "media", "tensors"])


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the WAV) and tensors (an Arrow stream of the segments)."""
    return texts(docs, id_col, text_col).mapInArrow(_extract, "doc_id long, n_bytes long, media binary, tensors binary")


def feature(arrow: bytes) -> str:
    t = pa.ipc.open_stream(arrow).read_all()
    meta = t.schema.metadata
    first = [[round(a, 4), round(b, 4)] for a, b in zip(t["start_s"].to_pylist()[:4], t["end_s"].to_pylist()[:4], strict=True)]
    spoken = sum(t["end_s"].to_pylist()) - sum(t["start_s"].to_pylist())
    return json.dumps({"frames": int(meta[b"frames"]), "segments": t.num_rows, "active_s": round(spoken, 4), "first_spans": first, "mean_log_mel": json.loads(meta[b"mean"])}, separators=(",", ":"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _extract(batches):
        media, arrow = b["media"].to_pylist(), b["tensors"].to_pylist()
        back = [from_wav(m) for m in media]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        cols = {
            "doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "payload_bytes": pa.array([len(x) for x in back], pa.int64()), "payload_sha256": sha(back),
            "tail_crc32": pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()), "media_bytes": pa.array([len(m) for m in media], pa.int64()), "media_sha256": sha(media),
            "feature": pa.array([feature(a) for a in arrow]),
        }
        yield pa.record_batch(list(cols.values()), list(cols))


def digest(docs: DataFrame) -> DataFrame:
    return texts(docs).mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").select("*")


def spans_of(extracted: DataFrame) -> DataFrame:
    """doc_id, seq, start_s, end_s and tensor (the values in C order) for each segment of extract()'s rows."""

    def rows(batches):
        for b in batches:
            for i, a in zip(b["doc_id"].to_pylist(), b["tensors"].to_pylist(), strict=True):
                t = pa.ipc.open_stream(a).read_all()
                tensor = t["log_mel"].combine_chunks().storage.cast(pa.list_(pa.float32())) if t.num_rows else pa.array([], pa.list_(pa.float32()))
                yield pa.record_batch([pa.array([i] * t.num_rows, pa.int64()), pa.array(range(t.num_rows), pa.int32()), t["start_s"].combine_chunks(), t["end_s"].combine_chunks(), tensor], ["doc_id", "seq", "start_s", "end_s", "tensor"])

    return extracted.select("doc_id", F.col("tensors")).mapInArrow(rows, "doc_id long, seq int, start_s double, end_s double, tensor array<float>")
