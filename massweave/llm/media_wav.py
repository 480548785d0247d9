"""Operator 8: texts as WAV media with spectral-peak pair fingerprints.

The payload is the text's UTF-8, filled with zero bytes to a positive multiple of 64, stored
losslessly as the 8-bit mono samples of a WAV file by the wave module and read back from it. A
short-time Fourier transform of the samples, in half-overlapping frames, gives every frame's strongest
peaks: bins louder than both neighbours. Each is paired with those of the next frames into codes of
(bin, bin, distance), kept as an array of ``frame << 32 | code``; the feature is its length and digest.

Cases: null and empty text give 64 zero bytes, silence and no pairs. Equal texts give equal values
in every column but doc_id. Long texts are transformed in blocks of frames. Nothing but doc_id
and text is read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import documents, map_rows

RATE, FRAME, HOP, PEAKS, AHEAD = 8000, 256, 128, 2, 2
BLOCK_FRAMES = 4096
WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes((-len(raw)) % 64 or (0 if raw else 64))


def to_wav(samples: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(samples)
        return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs, in order of time."""
    x = np.frombuffer(samples, np.uint8)
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    bins, loud = np.empty((n, PEAKS), np.int64), np.empty((n, PEAKS), bool)
    for at in range(0, n, BLOCK_FRAMES):
        k = min(BLOCK_FRAMES, n - at)
        y = np.full((k - 1) * HOP + FRAME, 128, np.uint8)
        part = x[at * HOP : at * HOP + len(y)]
        y[: len(part)] = part
        frames = (np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP].astype(np.float32) - 128) * WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1))
        inner = power[:, 1:-1]
        height = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        top = np.argpartition(-height, PEAKS - 1, axis=1)[:, :PEAKS]
        height = np.take_along_axis(height, top, 1)
        order = np.lexsort((top, -height), axis=1)
        bins[at : at + k] = np.take_along_axis(top, order, 1) + 1
        loud[at : at + k] = np.take_along_axis(height, order, 1) > 1e-3
    out = []
    for d in range(1, min(AHEAD, n - 1) + 1):
        for p in range(PEAKS):
            for q in range(PEAKS):
                both = loud[:-d, p] & loud[d:, q]
                t = np.flatnonzero(both)
                out.append(t << 32 | bins[:-d, p][t] << 16 | bins[d:, q][t] << 8 | d)
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def describe(text: str | None) -> tuple:
    n, data = payload(text)
    media = to_wav(data)
    back = from_wav(media)
    pairs = fingerprint(back)
    feature = f"peaks:{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()[:32]}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, pairs


def media(docs: DataFrame) -> DataFrame:
    """doc_id, wav (binary) and fingerprint (array<long>) of every document."""

    def task():
        def each(x: dict[str, list]) -> dict:
            wavs = [to_wav(payload(t)[1]) for t in x["text"]]
            return {"doc_id": x["doc_id"], "wav": wavs, "fingerprint": [fingerprint(from_wav(w)) for w in wavs]}

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, wav binary, fingerprint array<long>")


def digests(docs: DataFrame) -> DataFrame:
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint")

    def task():
        def each(x: dict[str, list]) -> dict:
            return {"doc_id": x["doc_id"]} | dict(zip(names, zip(*map(describe, x["text"])) if x["text"] else [()] * len(names)))

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>")


def op8_wav_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
