"""Texts as audio: lossless WAV samples, spectra and peak-pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # the payload is a positive multiple of this many bytes
RATE = 8000  # samples a second, as the stored form names it
FRAME, HOP = 128, 64  # with a hop of silence at either end, frames cover any payload to its last sample
BANDS = ((1, 9), (9, 25), (25, 65))  # frequency bins, from and up to, that each give a frame its peak
FRAMES_AT_ONCE = 4096
FAR, FAN_OUT = 32, 3  # frames from an anchor to its partners at most, and how many of them


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK) if data else bytes(BLOCK)


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples: a byte of the payload each."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of the spectral peaks, in that order.

    The samples stand between two hops of silence; zero bytes, as the padding has them, count as
    silence too, lest the step to them drown a short text. In each frame of their short-time Fourier
    transform the strongest bin of each band (the lowest of equal ones) is a peak if it is
    stronger than the same bin of the frame before and as strong as that of the frame behind.
    Silent frames have no peak. Frames are transformed in bounded chunks."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32)
    x = np.where(x == 0, np.float32(0), x - 128)
    silence = np.zeros(HOP, dtype=np.float32)
    x = np.concatenate((silence, x, silence))
    n = 1 + (len(x) - FRAME) // HOP
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, n, FRAMES_AT_ONCE):
        low, high = max(0, at - 1), min(n, at + FRAMES_AT_ONCE + 1)
        part = views[low:high]
        spectrum = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)).astype(np.float32)
        rows = np.arange(high - low)
        own = slice(at - low, at - low + min(FRAMES_AT_ONCE, n - at))
        found = []
        for first, last in BANDS:
            best = spectrum[:, first:last].argmax(axis=1) + first
            top = spectrum[rows, best]
            before = np.full(high - low, -1.0, dtype=np.float32)
            before[1:] = spectrum[rows[:-1], best[1:]]
            after = np.full(high - low, -1.0, dtype=np.float32)
            after[:-1] = spectrum[rows[1:], best[:-1]]
            where = np.flatnonzero(((top > before) & (top >= after) & (top > 1e-3))[own])
            found.append((where + at) << 8 | best[own][where])
        both = np.sort(np.concatenate(found))
        times.append(both >> 8)
        bins.append(both & 255)
    return np.concatenate(times), np.concatenate(bins)


def pair_codes(times: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Time-coded landmarks: each peak with its next FAN_OUT peaks (by frame, then bin) that start
    at most FAR frames later. A code is time << 24 | anchor bin << 16 | partner bin << 8 | frames between."""
    out = []
    for k in range(1, FAN_OUT + 1):
        if len(times) <= k:
            break
        gap = times[k:] - times[:-k]
        good = gap <= FAR
        out.append((times[:-k][good] << 24) | (bins[:-k][good] << 16) | (bins[k:][good] << 8) | gap[good])
    codes = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return np.sort(codes.astype(np.int64))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True, with_codes: bool = True) -> DataFrame:
    """Store every whole text as a WAV file, read it back and fingerprint it.

    The payload is the text's UTF-8 bytes with zero bytes up to a positive multiple of 64; its
    bytes are the samples. Returns doc_id, n_bytes (without the padding), payload_bytes,
    payload_sha256 (of what was read back), tail_crc32 (of its last 64 bytes), media_bytes and
    media_sha256 (of the file), n_peaks, n_codes, codes_sha256 (of peaks and codes, so that texts
    too short for a pair differ too), and if wanted media (the file)
    and codes (time-coded pair landmarks). Null and empty texts are 64 zero bytes, without
    peaks. Equal texts give equal values. Null ids and repeated rows are kept; other columns
    may have any name; an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_peaks", "n_codes", "codes_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_peaks long, n_codes long, codes_sha256 string"
    if with_media:
        names, kinds, schema = [*names, "media"], [*kinds, pa.binary()], schema + ", media binary"
    if with_codes:
        names, kinds, schema = [*names, "codes"], [*kinds, pa.list_(pa.int64())], schema + ", codes array<long>"

    def one(doc_id, text) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass")
        stored = to_wav(payload_of(data))
        back = from_wav(stored)
        times, bins = peaks(back)
        codes = pair_codes(times, bins)
        row = (doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), len(times), len(codes), hashlib.sha256(np.concatenate((times << 8 | bins, codes)).astype(">i8").tobytes()).hexdigest())
        return row + ((stored,) if with_media else ()) + ((codes,) if with_codes else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [one(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
