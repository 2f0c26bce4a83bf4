"""Media columns: audio kept as WAV bytes, and its features.

A text's bytes are taken as 8-bit samples: the payload (UTF-8, padded with
blanks to a positive multiple of 192) is stored losslessly as mono 8-bit PCM in
a WAV file of RATE samples a second, written as a binary column, read back and
decoded.  From the decoded samples come

* a polyphase resampling by UP/DOWN (one short filter for each output phase, no
  zero-stuffing),
* overlapped log-mel filterbanks (windows of 400, hop 160 at 16 kHz), kept as
  Arrow fixed-shape tensors of TENSOR (frames x bands) with the time span of each,
* segments by hysteresis on frame energy: a segment is a run above the lower
  threshold that reaches the upper one.

Audio is resampled and transformed in blocks of BLOCK_FRAMES frames, so beside its
bytes and its features a very long text takes no memory that grows with it.  Every
value of a row depends on its own bytes only, so equal texts and repeated rows give
equal values.  Null and empty texts give 192 blanks; an empty table gives an empty
result.  Ids are of any type and may be null; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 192
RATE, UP, DOWN = 24_000, 2, 3
WINDOW, HOP, FFT, BANDS = 400, 160, 512, 40
TENSOR = (64, BANDS)
BLOCK_FRAMES = 2048
#: dB above the median frame energy at which a segment begins and ends.
ENTER_DB, LEAVE_DB = 3.0, 1.0


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAV file of the payload (of even length)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file that wav() made; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def lowpass(up: int = UP, down: int = DOWN, taps: int = 12) -> np.ndarray:
    """A windowed-sinc filter, `taps` input samples wide on each phase: (up, taps)."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    return (up * h / h.sum()).reshape(taps, up).T[:, ::-1].astype(np.float32)


_FILTER = lowpass()


def resample(x: np.ndarray, begin: int = 0, end: int | None = None, phases: np.ndarray = _FILTER, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs begin to end of x (8-bit samples) at up/down times its rate: output m is
    phase (m*down) % up of the filter over the inputs before m*down // up; silence lies
    before the first input.  Only the inputs of these outputs are read."""
    end = len(x) * up // down if end is None else end
    out, taps = np.empty(max(0, end - begin), np.float32), phases.shape[1]
    if not len(out):
        return out
    first, last = begin * down // up - taps + 1, (end - 1) * down // up
    part = (x[max(0, first) : last + 1].astype(np.float32) - 128) / 128
    seen = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(max(0, -first), np.float32), part)), taps)
    for m in range(begin, min(begin + up, end)):
        k = len(range(m, end, up))
        out[m - begin :: up] = np.ascontiguousarray(seen[m * down // up - begin * down // up :: down][:k]) @ phases[m * down % up]
    return out


def mel_bank(rate: int = RATE * UP // DOWN, fft: int = FFT, bands: int = BANDS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale: (fft // 2 + 1, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1)[:, None] * rate / fft
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_BANK, _HANN = mel_bank(), np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log-mel energies (frames, bands) and frame energies in dB of 8-bit samples; at
    least one frame, and silence after the last sample."""
    n = len(x) * UP // DOWN
    frames = 1 + max(0, -(-(n - WINDOW) // HOP))
    mel, power = [], []
    for a in range(0, frames, BLOCK_FRAMES):
        b = min(frames, a + BLOCK_FRAMES)
        y = resample(x, a * HOP, min(n, (b - 1) * HOP + WINDOW))
        y = np.concatenate((y, np.zeros((b - 1 - a) * HOP + WINDOW - len(y), np.float32)))
        block = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * _HANN
        power.append(np.einsum("ij,ij->i", block, block))
        spectrum = np.fft.rfft(block, FFT)
        mel.append(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _BANK + 1e-6).astype(np.float32))
    return np.concatenate(mel), 10 * np.log10(np.concatenate(power) + 1e-10)


def segments(energy: np.ndarray, enter: float = ENTER_DB, leave: float = LEAVE_DB) -> list[tuple[int, int]]:
    """Frame ranges above `leave` that reach `enter`, both over the median."""
    level = energy - np.median(energy)
    low = np.concatenate(([False], level >= leave, [False]))
    edges = np.flatnonzero(low[1:] != low[:-1])
    high = np.concatenate(([0], np.cumsum(level >= enter)))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if high[b] > high[a]]


_TENSOR_TYPE = pa.fixed_shape_tensor(pa.float16(), TENSOR)
_TENSORS = pa.schema([("tensor", _TENSOR_TYPE), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors (the last one padded with zeros) and
    the time span of the frames of each."""
    n = -(-len(mel) // TENSOR[0])
    full = np.zeros((n * TENSOR[0], BANDS), np.float16)
    full[: len(mel)] = mel
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR[0] * TENSOR[1])
    step = HOP * DOWN / (UP * RATE)
    start = np.arange(n) * TENSOR[0]
    end = np.minimum(start + TENSOR[0], len(mel)) - 1
    batch = pa.record_batch([pa.ExtensionArray.from_storage(_TENSOR_TYPE, values), pa.array(start * step), pa.array(end * step + WINDOW * DOWN / (UP * RATE))], schema=_TENSORS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TENSORS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV): the media column of each whole text."""
    common.prepare(df.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            media = [wav(r.ljust(max(1, -(-len(r) // UNIT)) * UNIT, b" ")) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = common.id_and_text(df, id_col, text_col)
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, segments array<struct<start_s:double,end_s:double>>, tensors binary"


def audio_features(media: DataFrame) -> DataFrame:
    """Of doc_id, n_bytes, media: digests of the stored bytes, frames, segments
    (time spans) and tensors (an Arrow stream; see tensors())."""
    step = HOP * DOWN / (UP * RATE)

    def one(doc: object, n: int, stored: bytes) -> tuple:
        payload = samples_of(stored)
        mel, energy = log_mel(np.frombuffer(payload, np.uint8))
        spans = [{"start_s": a * step, "end_s": b * step} for a, b in segments(energy)]
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mel), spans, tensors(mel)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for a in range(0, batch.num_rows, 64):
                rows = [one(*r) for r in zip(*(c[a : a + 64] for c in columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kind = media.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
    schema = pa.schema([("doc_id", common._arrow(media.schema["doc_id"].dataType)), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int32()), ("segments", pa.list_(span)), ("tensors", pa.binary())])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(features, f"doc_id {kind}, {_FEATURES}")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = common.stored(to_media(common.table(spark, sf_dir, "documents")), "media")
    found = audio_features(media)
    voiced = F.aggregate("segments", F.lit(0.0), lambda total, s: total + (s["end_s"] - s["start_s"]))
    feature = F.concat_ws(":", F.col("frames").cast("string"), F.size("segments").cast("string"), F.round(voiced, 4).cast("string"), F.sha2("tensors", 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "frames", "segments", "tensors")
