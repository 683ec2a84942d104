"""Media columns: losslessly stored WAV bytes, read by the wave module, and spectral fingerprints.

``encode_media`` stores bytes as 8-bit mono samples; ``read_media`` opens the stored bytes again,
takes short-time Fourier transforms and pairs of spectral peaks. A peak is the strongest bin of its
band that is also stronger than the same bin a frame before and after; each peak is paired with the
next few, and a pair is stored as its time (frame) and a code of both bins and their distance.

Edge cases: null and empty text give one block of zero bytes; equal texts, so repeated rows too, give equal
bytes and fingerprints; of bins of equal strength the lowest is the peak, of equal frames the first; long texts are
transformed a block of frames at a time; an empty table gives an empty result; extra columns are dropped, whatever
their names.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts
from .token_files import cuts, slices

RATE, PAD = 8000, 64
FRAME, HOP, BLOCK = 256, 128, 2048
BANDS = ((1, 8), (8, 20), (20, 48), (48, 129))
FAN_OUT, REACH = 3, 63

_window = np.hanning(FRAME + 2)[1:-1].astype(np.float32)  # no sample weighs nothing


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes, to: int = PAD) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``to``."""
    return raw + bytes(-len(raw) % to if raw else to)


def spectra(samples: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(first frame, magnitudes, whether these are the last) by blocks of frames; neighbouring blocks share two frames.

    The last frame is filled up with silence, so every sample is in a frame.
    """
    x = samples.astype(np.float32) - 128
    hops = -(-max(0, len(x) - FRAME) // HOP)
    x = np.pad(x, (0, FRAME + hops * HOP - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    at = 0
    while True:
        part = frames[at : at + BLOCK + 2]
        last = at + BLOCK + 2 >= len(frames)
        yield at, np.abs(np.fft.rfft(part * _window, axis=1)), last
        if last:
            return
        at += BLOCK


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the spectral peaks, by frame, then bin."""
    times, bins = [], []
    for at, m, last in spectra(samples):
        n = len(m)
        found_t, found_b = [], []
        for low, high in BANDS:
            b = low + m[:, low:high].argmax(axis=1)
            rows = np.arange(n)
            own = m[rows, b]
            before, after = np.full(n, -1.0), np.full(n, -1.0)
            before[1:], after[:-1] = m[rows[:-1], b[1:]], m[rows[1:], b[:-1]]
            keep = (own > before) & (own >= after) & (own > 0)
            keep[0] &= at == 0
            keep[-1] &= last
            found_t.append(rows[keep] + at)
            found_b.append(b[keep])
        t, b = np.concatenate(found_t), np.concatenate(found_b)
        order = np.lexsort((b, t))
        times.append(t[order])
        bins.append(b[order])
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded peak pairs: (frame of the first peak, code)."""
    t, b = peaks(samples)
    times, codes = [], []
    for step in range(1, FAN_OUT + 1):
        gap = t[step:] - t[:-step]
        near = gap <= REACH
        times.append(t[:-step][near] if len(t) > step else np.empty(0, np.int64))
        codes.append(((b[:-step] << 14) | (b[step:] << 6) | gap)[near] if len(t) > step else np.empty(0, np.int64))
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def encode_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's UTF-8 bytes, padded, as a WAV value."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words in slices(batches):
            raw = [w.encode() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(texts(docs), encode, "doc_id bigint, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media, payload, fp_times, fp_codes)`` from the stored bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column(2), 1 << 20):
                part = batch.slice(a, b - a)
                payloads = [from_wav(x.as_py()) for x in part.column(2)]
                prints = [fingerprint(np.frombuffer(p, np.uint8)) for p in payloads]
                ends = np.concatenate([[0], np.cumsum([len(t) for t, _ in prints])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[i] for p in prints]))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(payloads, pa.binary()), *lists], names=["doc_id", "n_bytes", "media", "payload", "fp_times", "fp_codes"])

    return map_arrow(media.select("doc_id", "n_bytes", "media"), read, "doc_id bigint, n_bytes bigint, media binary, payload binary, fp_times array<int>, fp_codes array<int>")
