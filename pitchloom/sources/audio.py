"""Spectral peaks of sounds, read by Spark's binary source and analysed a file at a time in Arrow batches.

WAV is read here: PCM of 8, 16, 24 and 32 bits and IEEE floats of 32 and 64, plain or extensible. Other formats go to
the soundfile package where a worker has it. A file must fit a worker's memory.
"""

from __future__ import annotations

import io
import math
import struct
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PeakParams:
    """sigma: smoothing in cents (0: none, peaks on the FFT's bins); resolution: the grid in cents."""

    sigma: float = 0.0
    resolution: float = 1.0
    ramp_duration: float = 0.0
    f_min: float = 27.5
    f_max: float = math.inf
    min_prominence: float = 0.01
    noise_factor: float = 0.0


def chunks(content: bytes) -> dict[bytes, bytes]:
    """The first chunk of each kind of a RIFF file; one that claims more than there is ends with the file."""
    found, at = {}, 12
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        found.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples (PCM in [-1, 1], floats as they are) and their rate."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        try:
            import soundfile
        except ImportError:
            raise ValueError("only WAV is read without the soundfile package") from None
        x, rate = soundfile.read(io.BytesIO(content), dtype="float64", always_2d=True)
        return x.mean(axis=1), rate
    found = chunks(content)
    kind, channels, rate, _, frame, bits = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if kind == 0xFFFE:  # extensible: the kind stands at the head of the sub-format
        kind = struct.unpack_from("<H", found[b"fmt "], 24)[0]
    raw, width = found[b"data"], bits // 8
    raw = raw[: len(raw) // frame * frame]
    if kind == 3 and width in (4, 8):
        x = np.frombuffer(raw, f"<f{width}").astype(float)
    elif kind != 1 or width not in (1, 2, 3, 4):
        raise ValueError(f"WAV of kind {kind} and {bits} bits is not read")
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = ((b[:, 0].astype(np.int32) << 8 | b[:, 1].astype(np.int32) << 16 | b[:, 2].astype(np.int32) << 24) >> 8) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(2 ** (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def encode(x: np.ndarray, rate: int, kind: str = "pcm16", channels: int = 1) -> bytes:
    """A WAV file of samples in [-1, 1] on every channel: pcm8, pcm16, pcm24, pcm32, float32, float64."""
    bits = int(kind.lstrip("pcmfloat"))
    x = np.repeat(np.clip(x, -1, 1), channels)
    if kind.startswith("float"):
        raw = x.astype(f"<f{bits // 8}").tobytes()
    else:
        v = np.round(x * (2 ** (bits - 1) - 1)).astype("<i8")
        raw = (v + 128).astype(np.uint8).tobytes() if bits == 8 else v.view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    frame = channels * bits // 8
    head = struct.pack("<HHIIHH", 3 if kind.startswith("float") else 1, channels, rate, rate * frame, frame, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def synthesised(f: str, kind: str, partials: int = 6, rate: int = 44100, seconds: float = 1.0) -> Column:
    """A column content: for each row, the WAV bytes of harmonic tones at an array column of frequencies."""

    @F.pandas_udf("binary")
    def content(fs: pd.Series, kinds: pd.Series) -> pd.Series:
        t = np.arange(int(rate * seconds)) / rate
        sound = lambda tones: sum(np.sin(2 * np.pi * n * x * t) / n for x in tones for n in range(1, partials + 1))
        return pd.Series([encode(y / np.abs(y).max(), rate, k) for y, k in ((sound(x), k) for x, k in zip(fs, kinds, strict=True))])

    return content(f, kind).alias("content")


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch-Carlson); 0 outside the data."""
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(len(x))
    if len(x) == 2:
        d[:] = slope[0]
    else:
        same = slope[:-1] * slope[1:] > 0
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            d[1:-1] = np.where(same, (w1 + w2) / (w1 / slope[:-1] + w2 / slope[1:]), 0.0)
        for end, (h0, h1, s0, s1) in ((0, (h[0], h[1], slope[0], slope[1])), (-1, (h[-1], h[-2], slope[-1], slope[-2]))):
            g = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            d[end] = 0.0 if g * s0 <= 0 else 3 * s0 if s0 * s1 < 0 and abs(g) > 3 * abs(s0) else g
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    value = (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * d[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * d[k + 1]
    return np.where((at >= x[0]) & (at <= x[-1]), value, 0.0)


def prominent(y: np.ndarray, least: float) -> np.ndarray:
    """Local maxima (the middle of a plateau) that stand out by at least so much.

    A peak's prominence is its height over the higher of the lowest points on the way to higher ground on its left and
    right; a stack of falling heights keeps those points, so all peaks take one pass from each side.
    """
    edges = np.flatnonzero(np.diff(y) != 0)
    starts, ends = np.r_[0, edges + 1], np.r_[edges, len(y) - 1]
    level = y[starts]
    top = np.r_[False, (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:]), False] if len(level) > 2 else np.zeros(len(level), bool)

    def lowest(values: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(values)), []
        for i, v in enumerate(values.tolist()):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            out[i] = low
            stack.append((v, low))
        return out

    # plateaus are single levels here, so higher ground is strictly higher
    base = np.maximum(lowest(level), lowest(level[::-1])[::-1])
    keep = np.flatnonzero(top & (level - base >= least))
    return (starts[keep] + ends[keep]) // 2


@dataclass(frozen=True)
class Spectrum:
    """Within the band: frequencies and magnitudes of the transform, and what peaks are sought in (smoothed or the same)."""

    f: np.ndarray
    magnitude: np.ndarray
    at: np.ndarray
    value: np.ndarray


def spectrum(x: np.ndarray, rate: int, q: PeakParams) -> Spectrum:
    none = np.zeros(0)
    ramp = round(q.ramp_duration * rate)
    if 0 < ramp <= len(x) // 2:
        rise = 0.5 - 0.5 * np.cos(np.pi * np.arange(ramp) / ramp)
        x = np.concatenate([x[:ramp] * rise, x[ramp:-ramp], x[-ramp:] * rise[::-1]])
    elif ramp > 0:
        warnings.warn("the ramp is longer than half the signal and is not applied", stacklevel=3)
    top = min(q.f_max, rate / 2)
    if q.f_min >= top:
        raise ValueError("f_min must be below f_max")
    magnitude = np.abs(np.fft.rfft(x)) / max(1, len(x))
    magnitude[1:-1] *= 2
    f = np.arange(len(magnitude)) * (rate / max(1, len(x)))
    band = (f >= q.f_min) & (f <= top)
    f, magnitude = f[band], magnitude[band]
    if len(f) < 2 or q.sigma <= 0:
        return Spectrum(f, magnitude, f, magnitude)
    cents = 6900 + 1200 * np.log2(f / 440)
    first, last = math.ceil(cents[0] / q.resolution), math.floor(cents[-1] / q.resolution)
    grid = np.arange(first, last + 1) * q.resolution
    if len(grid) < 2:
        return Spectrum(f, magnitude, none, none)
    reach = math.ceil(4 * q.sigma / q.resolution)
    kernel = np.exp(-((np.arange(-reach, reach + 1) * q.resolution) ** 2) / (2 * q.sigma**2))
    smooth = np.convolve(np.maximum(pchip(cents, magnitude, grid), 0), kernel / kernel.sum(), mode="same")
    at = 440 * 2 ** ((grid - 6900) / 1200)
    return Spectrum(f, magnitude, at if len(smooth) == len(at) else 440 * 2 ** (((np.arange(len(smooth)) + first) * q.resolution - 6900) / 1200), smooth)


def peaks(x: np.ndarray, rate: int, q: PeakParams) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies in Hz and weights relative to the strongest."""
    found = spectrum(x, rate, q)
    f, value = found.at, found.value
    if len(f) < 2 or value.max() == 0:
        return np.zeros(0), np.zeros(0)
    at = prominent(value, q.min_prominence * value.max())
    if q.noise_factor > 0:
        at = at[value[at] > q.noise_factor * np.median(value)]
    return (f[at], value[at] / value[at].max()) if len(at) else (np.zeros(0), np.zeros(0))


def _each_file(files: DataFrame, schema: str, result: Callable[[bytes], list[np.ndarray]]) -> DataFrame:
    """Columns of arrays for each row (path, content)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns = result(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *map(pa.array, columns)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def peaks_of(files: DataFrame, params: PeakParams = PeakParams()) -> DataFrame:
    """(path, f, w): a row for each peak of each row (path, content)."""
    if params.f_min >= params.f_max:
        raise ValueError("f_min must be below f_max")
    return _each_file(files, "path string, f double, w double", lambda content: [np.asarray(x, float) for x in peaks(*decode(content), params)])


def spectra_of(files: DataFrame, params: PeakParams = PeakParams(), smoothed: bool = False) -> DataFrame:
    """(path, f, magnitude): the detail behind the peaks, the transform's magnitudes in the band or the smoothed ones."""

    def result(content: bytes) -> list[np.ndarray]:
        found = spectrum(*decode(content), params)
        return [found.at, found.value] if smoothed else [found.f, found.magnitude]

    return _each_file(files, "path string, f double, magnitude double", result)


def samples_of(files: DataFrame) -> DataFrame:
    """(path, rate, samples) of each sound, mono."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                x, rate = decode(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([x], pa.list_(pa.float64()))], ["path", "rate", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, rate int, samples array<double>")


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def audio_peaks(spark: SparkSession, path: str, params: PeakParams = PeakParams()) -> DataFrame:
    """(path, f, w): a row for each peak of each file below a path; files without peaks give none."""
    return peaks_of(read_sounds(spark, path), params)
