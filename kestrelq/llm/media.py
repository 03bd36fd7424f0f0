"""Media columns: texts stored as WAV sound, read back, and fingerprinted by spectral peak pairs."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import arrow_map, body, quoted

RATE = 8000
#: Samples a frame, between frame starts, frames a block of the transform.
FRAME, HOP, BLOCK = 256, 128, 4096
#: Spectral bands (of bins), each with one peak, its strongest bin.
BANDS = ((1, 8), (8, 16), (16, 32), (32, 64), (64, 96), (96, 129))
#: A frame's loudest peak pairs with its second one (0 frames between) and with those of the following frames.
REACH = 3


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """``text`` and zero bytes up to a positive multiple of ``unit``."""
    return text + bytes(-len(text) % unit or (unit if not text else 0))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per frame: the bins of the loudest and the second loudest band's peak, and whether there is sound."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    x = np.zeros((n - 1) * HOP + FRAME, np.float32)
    x[: len(samples)] = samples.astype(np.float32) - 128
    window = np.hanning(FRAME).astype(np.float32)
    bins, loud = [], []
    for a in range(0, n, BLOCK):
        frames = np.lib.stride_tricks.sliding_window_view(x[a * HOP : (min(n, a + BLOCK) - 1) * HOP + FRAME], FRAME)[::HOP]
        frames = frames - frames.mean(axis=1, keepdims=True)  # the level of a text's bytes is no tone
        power = np.abs(np.fft.rfft(frames * window, axis=1))
        best = np.stack([lo + power[:, lo:hi].argmax(1) for lo, hi in BANDS], 1)
        height = np.take_along_axis(power, best, 1)
        top = np.argsort(-height, axis=1, kind="stable")[:, :2]
        bins.append(np.take_along_axis(best, top, 1))
        loud.append(height.max(1) > 1e-3)
    return np.concatenate(bins), np.concatenate(loud)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of spectral peaks, in order of time: frame << 32 | bin << 20 | other bin << 8 | frames between."""
    bins, loud = peaks(samples)
    out = []
    for d in range(REACH + 1):
        at = np.flatnonzero(loud[: len(loud) - d] & loud[d:])
        other = bins[at + d, 0] if d else bins[at, 1]
        out.append((at << 32) | (bins[at, 0].astype(np.int64) << 20) | (other.astype(np.int64) << 8) | d)
    return np.sort(np.concatenate(out))


def fingerprint_text(codes: np.ndarray) -> str:
    """The whole fingerprint's size and digest: equal sounds, equal strings."""
    return f"{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False, codes: bool = False) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature per row;
    with ``media`` and ``codes`` the stored form and the fingerprint array too.

    A null or empty text is one unit of zero bytes. Very long texts are transformed whole, in blocks of frames; of
    equally loud peaks the lower one counts. Equal texts have equal values whatever their ids; texts of a few frames
    with the same peaks share a feature (and no digest). Repeated rows give a row each, an empty table none. Other
    columns, whatever their names, are not read.
    """
    rows = docs.select(quoted(id_col).alias("id"), body(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "fingerprint"]

    def run(b: pa.RecordBatch):
        out = []
        for text in b["text"].to_pylist():
            stored = to_wav(payload_of(text))
            back = from_wav(stored)
            found = fingerprint(np.frombuffer(back, np.uint8))
            out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), fingerprint_text(found), stored if media else None, found if codes else None))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        cols = [b["id"], *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))]
        use = [*range(8), *[8] * media, *[9] * codes]
        yield pa.RecordBatch.from_arrays([cols[i] for i in use], [names[i] for i in use])

    more = ", media binary" * media + ", fingerprint array<long>" * codes
    return rows.mapInArrow(arrow_map(run, "text"), f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{more}")
