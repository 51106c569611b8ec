"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload of bytes is kept as 8-bit mono samples in a WAV file held in a binary column, written and read
by the wave module. Features come from the stored bytes: Hann-windowed spectra of overlapping
frames, the strongest bin of each band as peaks where it stands out in its frame and from the frames before and after, and pairs of
each peak with the next few of later frames within reach. A pair is one 64-bit number, its first frame above
(bin, bin, frames between), so the array is in order of time.

All work is by row; payloads of any length are transformed in stretches of frames. Nulls: a null text is an empty payload, padded like
any other; a null medium gives nulls. Ties: the lower bin of a band, the later of equal neighbours in time. Repeated rows each give a
row; other columns, whatever their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

RATE = 8000
FRAME = 288
HOP = 144
PAD_BYTE = 255
#: Payloads are padded to a multiple of this.
UNIT = 576
#: Upper edges of the bands, in bins; bin 0 is left out.
BANDS = (1, 6, 11, 21, 41, 81, 145)
#: Later peaks each peak is paired with, and the frames within which they lie.
FAN_OUT = 3
REACH = 8
STRETCH_FRAMES = 2048
TAIL_BYTES = 32
_WINDOW = np.hanning(FRAME).astype(np.float32)

FEATURES = StructType(
    [
        StructField("payload_bytes", LongType()),
        StructField("payload_sha256", StringType()),
        StructField("tail_crc32", LongType()),
        StructField("media_bytes", LongType()),
        StructField("media_sha256", StringType()),
        StructField("frames", LongType()),
        StructField("peaks", LongType()),
        StructField("pairs", ArrayType(LongType())),
    ]
)


def padded_payload(text: str | None, unit: int = UNIT) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([PAD_BYTE]) * (max(unit, -(-len(data) // unit) * unit) - len(data))


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getnchannels() != 1 or r.getsampwidth() != 1:
            raise ValueError("expected 8-bit mono samples")
        return r.readframes(r.getnframes())


def spectral_peaks(samples: bytes) -> tuple[int, np.ndarray]:
    """Number of frames, and (frame, bin) of every peak, in order of frame, then bin."""
    x = np.frombuffer(samples, np.uint8)
    n = max(0, (len(x) - FRAME) // HOP + 1)
    found = []
    for a in range(0, n, STRETCH_FRAMES):
        b = min(a + STRETCH_FRAMES, n)
        first, last = max(a - 1, 0), min(b + 1, n)  # with a frame on either side
        part = x[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW
        spectrum = np.fft.rfft(frames, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        bins = np.stack([power[:, lo:hi].argmax(axis=1) + lo for lo, hi in zip(BANDS, BANDS[1:])], axis=1)
        best = np.take_along_axis(power, bins, axis=1)
        loud = np.log1p(best)
        peak = loud > loud.mean(axis=1, keepdims=True)
        peak[1:] &= best[1:] >= np.take_along_axis(power[:-1], bins[1:], axis=1)
        peak[:-1] &= best[:-1] > np.take_along_axis(power[1:], bins[:-1], axis=1)
        frame, band = np.nonzero(peak[a - first : b - first])
        found.append(np.stack([frame + a, bins[frame + a - first, band]], axis=1))
    return n, np.concatenate(found) if found else np.empty((0, 2), np.int64)


def peak_pairs(peaks: np.ndarray) -> np.ndarray:
    """frame << 32 | bin << 20 | later bin << 8 | frames between, for the pairs of every peak in turn with peaks of later frames."""
    t, f = peaks[:, 0], peaks[:, 1]
    j = np.searchsorted(t, t, side="right")[:, None] + np.arange(FAN_OUT)
    i = np.broadcast_to(np.arange(len(t))[:, None], j.shape)
    i, j = i[j < len(t)], j[j < len(t)]
    gap = t[j] - t[i]
    near = gap <= REACH
    i, j, gap = i[near], j[near], gap[near]
    return t[i] << 32 | f[i] << 20 | f[j] << 8 | gap


def media_features(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * len(FEATURES)
    payload = wav_samples(media)
    n, peaks = spectral_peaks(payload)
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-TAIL_BYTES:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        n,
        len(peaks),
        peak_pairs(peaks),
    )


@pandas_udf(BinaryType())
def _to_wav(texts: pd.Series) -> pd.Series:
    return pd.Series([wav_bytes(padded_payload(t)) for t in texts], dtype=object)


@pandas_udf(FEATURES)
def _features(media: pd.Series) -> pd.DataFrame:
    rows = [media_features(m) for m in media]
    out = pd.DataFrame(rows, columns=[f.name for f in FEATURES])
    return out.astype({f.name: "Int64" for f in FEATURES if f.dataType == LongType()})


def text_to_wav(text: Column) -> Column:
    """A binary WAV column: the text's UTF-8 bytes, padded, as samples."""
    return _to_wav(text)


def wav_features(media: Column) -> Column:
    """A struct of checksums, counts and the time-coded array of pairs, from stored WAV bytes."""
    return _features(media)


def pair_digest(features: Column) -> Column:
    """One string for the fingerprint array of a medium."""
    return F.concat_ws(":", features["frames"], features["peaks"], F.size(features["pairs"]), F.lower(F.lpad(F.hex(F.xxhash64(features["pairs"])), 16, "0")))
