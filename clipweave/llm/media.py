"""Byte payloads as WAV media columns, with spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

RATE, FRAME, HOP = 8000, 192, 96
#: A peak is the largest bin in its frame and its band's neighbourhood; pairs look this many peaks ahead, no more frames than REACH.
BANDS, AHEAD, REACH = 4, 3, 31
BLOCK = 1 << 14  # frames transformed at once


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as the 8-bit samples of a mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and frequency bins of the peaks of the short-time spectrum: the loudest bin of each band, where no neighbouring frame is louder there."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples.astype(np.float32) - np.float32(128)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    bins = FRAME // 2
    width = bins // BANDS
    tops, louds = [], []
    for a in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[a : a + BLOCK] * window, axis=1))[:, 1 : bins + 1].reshape(-1, BANDS, width)
        tops.append(power.argmax(2))
        louds.append(power.max(2))
    top, loud = np.concatenate(tops), np.concatenate(louds)
    edge = np.full((1, BANDS), -1.0)
    peak = (loud > np.concatenate((edge, loud[:-1]))) & (loud >= np.concatenate((loud[1:], edge))) & (loud > 1)
    at, band = np.nonzero(peak)
    return at, top[at, band] + band * width + 1


def peak_pairs(at: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame of the first peak) and codes (first bin, second bin, frames between, as one number) of pairs of near peaks."""
    times, codes = [], []
    for k in range(1, AHEAD + 1):
        gap = at[k:] - at[:-k]
        near = gap <= REACH
        times.append(at[:-k][near])
        codes.append((freq[:-k][near] << 16 | freq[k:][near] << 8 | gap[near]).astype(np.int64))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def store_media(docs: DataFrame, multiple: int = 192) -> DataFrame:
    """doc_id, n_bytes, media: every whole text's UTF-8 bytes, filled with blanks to a positive multiple, as a WAV file in a binary column; saved.

    Null and empty texts are one multiple of blanks; repeated rows and null ids stay.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, media = [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                data = data or b""
                sizes.append(len(data))
                media.append(to_wav(data.ljust(max(1, -(-len(data) // multiple)) * multiple)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(store, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """For each stored WAV: payload, and the fingerprints as two arrays of equal length, times and codes, sorted by time.

    Repeated rows and null ids stay; equal media have equal fingerprints; an empty table stays empty.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            times, codes, payloads = [], [], []
            for data in batch.column("media").to_pylist():
                payload = from_wav(data)
                t, c = peak_pairs(*spectral_peaks(np.frombuffer(payload, np.uint8)))
                payloads.append(payload)
                times.append(t)
                codes.append(c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "media", "payload", "times", "codes"])

    return media.mapInArrow(features, "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")


def store_fingerprints(rows: DataFrame) -> DataFrame:
    """The fingerprints (times, codes) with whatever else their rows have, saved as array columns; two equal texts have equal arrays, a silent or very short one has empty arrays."""
    return saved(rows, "fingerprints")
