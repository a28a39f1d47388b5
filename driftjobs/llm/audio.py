"""Audio columns: bytes stored as 8-bit sound, read back, resampled and described by log-mel tensors and active spans."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import fine_text, parts, sized_batches, tidy

RATE, UP, DOWN = 8000, 3, 4
TAPS = 24  # of each phase
FRAME, HOP, FFT, BANDS = 192, 96, 256, 24
CHUNK = 16  # frames in a tensor
ON_DB, OFF_DB = 3.0, -3.0  # against the median frame
BLOCK = 1 << 16
FEATURES = "struct<frames:int,seconds:double,spans:array<struct<start:double,end:double>>,tensor:binary>"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of 8-bit unsigned samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: str | None, unit: int = 64) -> bytes:
    data = b"" if text is None else text.encode("utf-8")
    return data + bytes(-len(data) % unit or (0 if data else unit))


@lru_cache
def _phases() -> np.ndarray:
    """Taps of each phase of a windowed sinc that cuts at the lower of the two rates, reversed for a sliding product."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    low = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    low *= UP / low.sum()
    return np.stack([low[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Rate times UP / DOWN by a polyphase filter: each output takes the taps of its own phase only."""
    out = np.empty(max(1, len(samples) * UP // DOWN), dtype=np.float32)
    x = np.concatenate((np.zeros(TAPS // 2 - 1, np.float32), samples, np.zeros(TAPS, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    for at in range(0, len(out), BLOCK * UP):
        stop = min(len(out), at + BLOCK * UP)
        for first in range(at, min(at + UP, stop)):
            n = np.arange(first, stop, UP)
            out[first:stop:UP] = windows[n * DOWN // UP] @ _phases()[first * DOWN % UP]
    return out


@lru_cache
def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hertz = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    up = (bins[:, None] - hertz[:-2]) / (hertz[1:-1] - hertz[:-2])
    down = (hertz[2:] - bins[:, None]) / (hertz[2:] - hertz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(sound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log filterbank energies and power in dB of overlapping frames; the last frame is filled with zeros."""
    frames = max(1, -(-(len(sound) - FRAME) // HOP) + 1)
    sound = np.concatenate((sound, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(sound)), np.float32)))
    views = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP][:frames]
    bands, power = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    shape = np.hanning(FRAME).astype(np.float32)
    for at in range(0, frames, 8192):
        part = views[at : at + 8192] * shape
        power[at : at + 8192] = 10 * np.log10((part * part).mean(axis=1) + 1e-10)
        spectrum = np.fft.rfft(part, FFT, axis=1)
        bands[at : at + 8192] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _mel() + 1e-6)
    return np.round(bands, 3), power


def active_spans(power: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds: a span opens at ON_DB over the median frame and goes on, both ways, while power is over OFF_DB."""
    level = power - np.median(power)
    over, peak = level > OFF_DB, level >= ON_DB
    edges = np.flatnonzero(np.diff(np.r_[False, over, False].astype(np.int8)))
    peaks = np.r_[0, np.cumsum(peak)]
    rate = RATE * UP / DOWN
    return [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in edges.reshape(-1, 2).tolist() if peaks[b] > peaks[a]]


def tensors(bands: np.ndarray) -> bytes:
    """An Arrow stream: a fixed-shape tensor of CHUNK frames by BANDS for each part of the sound, and its time span."""
    frames, rate = len(bands), RATE * UP / DOWN
    chunks = -(-frames // CHUNK)
    filled = np.zeros((chunks * CHUNK, BANDS), np.float32)
    filled[:frames] = bands
    start = np.arange(chunks) * CHUNK
    end = np.minimum(start + CHUNK, frames) - 1
    batch = pa.record_batch({
        "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(chunks, CHUNK, BANDS)),
        "start": pa.array(start * HOP / rate),
        "end": pa.array((end * HOP + FRAME) / rate),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def describe(media: bytes) -> dict:
    samples = np.frombuffer(from_wav(media), dtype=np.uint8)
    sound = resample((samples.astype(np.float32) - 128) / 128)
    bands, power = log_mel(sound)
    spans = [{"start": s, "end": e} for s, e in active_spans(power)]
    return {"frames": len(bands), "seconds": len(samples) / RATE, "spans": spans, "tensor": tensors(bands)}


def sound(text: F.Column) -> F.Column:
    """The stored file of a text, the payload read back from it, and its features, in one pass."""
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
    features = pa.struct([("frames", pa.int32()), ("seconds", pa.float64()), ("spans", span), ("tensor", pa.binary())])
    kind = pa.struct([("media", pa.binary()), ("payload", pa.binary()), ("features", features)])

    def stored(text: str | None) -> dict:
        media = to_wav(padded(text))
        return {"media": media, "payload": from_wav(media), "features": describe(media)}

    @F.arrow_udf(f"struct<media:binary,payload:binary,features:{FEATURES}>")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in parts(texts):
                yield pa.array([stored(t.as_py()) for t in part], kind)
        tidy()

    return each(text)


def audio_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``media`` (the stored file), ``payload`` (read back from it) and ``features``, which replace columns of those names.

    The file holds the UTF-8 bytes of the text, filled with zero bytes to a positive multiple of 64, as 8-bit
    samples. Every row stands alone, so nothing is shuffled; memory is bounded by blocks of frames, whatever
    the length. A null or empty text is stored as 64 zero bytes. Equal texts have equal values. Repeated rows
    stay; an empty table stays empty. Bytes that aren't UTF-8 are stored as those of U+FFFD.
    """
    found = sized_batches(docs).withColumn("__sound", sound(fine_text(text_col)))
    return found.withColumns({c: F.col(f"__sound.{c}") for c in ("media", "payload", "features")}).drop("__sound")
