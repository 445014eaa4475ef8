"""Media columns: texts as sound, kept losslessly, read back and fingerprinted.

A payload of bytes becomes the 8-bit samples of a mono WAV file, written and read by the wave module. Its short-time Fourier
transform, in frames that overlap by half, gives one spectral peak for each of a few bands in each frame; each peak is paired
with those of the frame's later bands and with the peaks of the next frames, and a pair (first band's bin, second's bin, hops
between) with the frame it starts in is a landmark. Landmarks are stored as an array of longs: in the upper half the start in
whole frame lengths, in the lower the hops beyond that and then the pair's hash of 22 bits, in ascending order.

A payload shorter than a frame stands in its middle, and what the last frame lacks is filled, at the payload's mean. The
strongest peak of a frame always counts; if no two peaks make a pair, each is paired with itself. Within the first and last HOP samples only one
frame sees a sample, with the falling weight of its window. Rows that repeat a text have the same values, and other columns aren't looked at. Null and empty texts have the payload of PAD spaces. Silence has no
peaks, and so has a payload of one byte. Sizes are bounded by the longest text, which one
task holds; frames are transformed some thousands at a time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = 192
RATE = 8000
FRAME = 512
HOP = FRAME // 2
#: Edges of the bands in which a frame's peak is sought, in bins of the transform.
BANDS = (2, 24, 64, 128, 257)
#: Hops ahead up to which a peak's partners are sought: two frame lengths.
AHEAD = 2 * FRAME // HOP
#: Frames transformed at once.
STEP = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of PAD bytes."""
    return text.ljust(max(1, -(-len(text) // PAD)) * PAD, b" ")


def encode(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(1)
        sound.setframerate(RATE)
        sound.writeframes(samples)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as sound:
        return sound.readframes(sound.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Bin of the strongest peak for each frame and band; -1: none stands out."""
    raw = np.frombuffer(samples, np.uint8)
    count = max(1, -(-(len(raw) - FRAME) // HOP) + 1)
    padded = np.full((count - 1) * HOP + FRAME, round(raw.mean()) if len(raw) else 128, np.uint8)
    first = max(0, FRAME - len(raw)) // 2
    padded[first : first + len(raw)] = raw
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    found = np.empty((count, len(BANDS) - 1), np.int64)
    for start in range(0, count, STEP):
        part = frames[start : start + STEP].astype(np.float32) - 128
        part -= part.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(part * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        floor = np.minimum(2 * power[:, BANDS[0] :].mean(axis=1), np.nextafter(power[:, BANDS[0] :].max(axis=1), -1, dtype=np.float32))
        floor = np.maximum(floor, 0)
        for k, (a, b) in enumerate(zip(BANDS, BANDS[1:])):
            best = power[:, a:b].argmax(axis=1)
            strong = np.take_along_axis(power[:, a:b], best[:, None], axis=1)[:, 0] > floor
            found[start : start + STEP, k] = np.where(strong, best + a, -1)
    return found


def landmarks(found: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks, ascending."""
    count, bands = found.shape
    start = np.arange(count) * HOP
    time = start // FRAME << 32 | start % FRAME // HOP << 22
    out = []
    for ahead in range(AHEAD + 1):
        for i in range(bands):
            for j in range(bands if ahead else i):
                first, second = found[: max(0, count - ahead), i], found[ahead:, j]
                both = (first >= 0) & (second >= 0)
                out.append(time[: len(first)][both] | first[both] << 13 | second[both] << 4 | ahead)
    if not any(map(len, out)):
        out = [time[one >= 0] | one[one >= 0] << 13 | one[one >= 0] << 4 for one in found.T]
    return np.sort(np.concatenate(out))


def _described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch:
            media = encode(payload(text))
            back = decode(media)
            marks = landmarks(peaks(back)).astype("<i8")
            rows.append((
                len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(),
                f"{len(marks)}:{hashlib.md5(marks.tobytes()).hexdigest()}", len(marks),
            ))
        yield pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_landmarks"])


def described(text: Column) -> Column:
    """Struct of sizes, digests and the digest of the landmarks, of a column of bytes; the media stay in the worker."""
    kind = "struct<n_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string, n_landmarks: bigint>"
    return F.pandas_udf(_described, kind)(text)


def wav(text: Column) -> Column:
    """The media column itself."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encode(payload(x)) for x in batch], dtype=object)

    return F.pandas_udf(run, "binary")(text)


def fingerprint(media: Column) -> Column:
    """Landmarks of a media column, as array<bigint>; null for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else landmarks(peaks(decode(x))) for x in batch], dtype=object)

    return F.pandas_udf(run, "array<bigint>")(media)
