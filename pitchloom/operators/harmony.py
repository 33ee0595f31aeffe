"""Consonance of chords: spectra on grids, correlation with a harmonic template, pairs of partials.

A chord's grid depends on its own highest partial, so it is an array of that set's own length, made and reduced in
one row; correlations at fine resolution and densities of many partials use numpy in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SpectrumSpec, checked, one_row_each
from ..plans.grids import steps_to
from .spectra import add_spectra

DEFAULT_TEMPLATE = SpectrumSpec.of("harmonic", 36, "powerlaw", 1)
DEFAULT_TENSOR = SpectrumSpec.of("harmonic", 64, "powerlaw", 1)


def lowered(df: DataFrame) -> DataFrame:
    """Positions less the set's least, which is kept as p0."""
    least = df.groupBy("set_id").agg(F.min("p").alias("p0"))
    return df.join(least, "set_id").select("set_id", (F.col("p") - F.col("p0")).alias("p"), "w", "p0")


def spectral_entropy(df: DataFrame, sigma: float = 12.0, *, spectrum: SpectrumSpec | None = None, normalize: bool = True, base: float = 2.0, resolution: float = 1.0, reach: float = 9.0) -> DataFrame:
    """(set_id, entropy) of the smoothed spectrum on a grid from the least pitch, up to 4 sigma past the highest.

    A kernel is summed up to ``reach`` widths from its partial. Beyond 9 it is below exp(-40.5), 3e-18 of its peak, less
    than a double keeps beside the peak; from 38.7 on a kernel is 0 in doubles, and nothing is left out.
    """
    low = lowered(df)
    rich = add_spectra(low, spectrum) if spectrum else low
    most = rich.groupBy("set_id").agg(F.ceil((F.max("p") + F.lit(4 * sigma + resolution)) / F.lit(float(resolution))).alias("n"))
    far = reach * sigma
    first = F.greatest(F.ceil((F.col("p") - far) / resolution), F.lit(0).cast("long"))
    last = F.least(F.floor((F.col("p") + far) / resolution), F.col("n") - 1)
    at = rich.join(most, "set_id").select("set_id", "n", "p", "w", F.explode(F.sequence(first, last)).alias("i"))
    d = F.col("p") - F.col("i") * F.lit(float(resolution))
    bins = at.groupBy("set_id", "n", "i").agg(F.sum(F.col("w") * F.exp(-d * d / (2 * sigma**2))).alias("t"))
    t = F.col("t")
    h = bins.groupBy("set_id", "n").agg(F.sum(t).alias("s"), F.sum(F.when(t > 0, t * F.log(t)).otherwise(0.0)).alias("x"))
    value = (F.log("s") - F.col("x") / F.col("s")) / (F.log(F.col("n").cast("double")) if normalize else F.lit(math.log(base)))
    return h.select("set_id", F.when(F.col("s") > 0, value).otherwise(0.0).alias("entropy"))


def _spectrum_arrays(spec: SpectrumSpec) -> tuple[np.ndarray, np.ndarray]:
    if spec.mode == "custom":
        return np.array(spec.offsets), np.array(spec.weights)
    n, k = np.arange(1, int(spec.n) + 1, dtype=float), spec.parameter
    ratio = {"harmonic": lambda: np.log2(n), "stretched": lambda: k * np.log2(n), "freqlinear": lambda: np.log2((n + k) / (1 + k)), "stiff": lambda: np.log2(n * np.sqrt(1 + k * n * n) / math.sqrt(1 + k))}[spec.mode]()
    return spec.units * ratio, n**-spec.rate if spec.decay == "powerlaw" else spec.rate ** (n - 1)


def _on_grid(p: np.ndarray, w: np.ndarray, sigma: float, resolution: float, block: int = 128) -> np.ndarray:
    x = np.arange(math.ceil((p.max() + 4 * sigma + resolution) / resolution)) * resolution
    out = np.zeros(len(x))
    for at in range(0, len(p), block):
        out += w[at : at + block] @ np.exp(-((x - p[at : at + block, None]) ** 2) / (2 * sigma**2))
    return out


def _correlations(df: DataFrame, schema: str, finish: Callable[[np.ndarray], list[np.ndarray]], sigma: float, spectrum: SpectrumSpec, chord_spectrum: SpectrumSpec | None, resolution: float, rows: int = 64) -> DataFrame:
    """finish(p0, correlation, template length) -> columns, for each set; a batch holds the columns of ``rows`` sets."""
    kind = dict(df.dtypes)["set_id"]
    tp, tw = _spectrum_arrays(spectrum)
    template = _on_grid(tp, tw, sigma, resolution)
    extra = _spectrum_arrays(chord_spectrum) if chord_spectrum else (np.zeros(1), np.ones(1))
    names = [c.split()[0] for c in schema.split(", ")]

    def correlation(elems: list[dict]) -> tuple[float, np.ndarray]:
        p, w = np.array([e["p"] for e in elems]), np.array([e["w"] for e in elems])
        chord = _on_grid((p[:, None] - p.min() + extra[0]).ravel(), (w[:, None] * extra[1]).ravel(), sigma, resolution)
        size = len(chord) + len(template) - 1
        full = 1 << (size - 1).bit_length()
        # at 1-cent grids of thousands of points the transform costs a hundredth of the direct sum
        x = np.fft.irfft(np.fft.rfft(chord, full) * np.fft.rfft(template[::-1], full), full)[:size]
        norm = math.sqrt((chord**2).sum() * (template**2).sum())
        return p.min(), np.maximum(x, 0) / norm if norm > 0 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = [finish(*correlation(elems), len(template)) for elems in batch.column("elems").to_pylist()]
                of_set = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("set_id").take(pa.array(of_set)), *columns], names)

    return one_row_each(df).mapInArrow(run, schema.format(kind=kind))


def template_harmonicity(df: DataFrame, sigma: float = 12.0, *, spectrum: SpectrumSpec = DEFAULT_TEMPLATE, chord_spectrum: SpectrumSpec | None = None, normalize: bool = True, base: float = 2.0, resolution: float = 1.0) -> DataFrame:
    """(set_id, h_max, h_entropy) of the correlation of a chord's spectrum with a harmonic template."""

    def finish(p0: float, x: np.ndarray, n: int) -> list[np.ndarray]:
        q = x / x.sum() if x.sum() > 0 else x
        q = q[q > 0]
        h = float(-(q * np.log(q)).sum() / (math.log(len(x)) if normalize else math.log(base)))
        return [np.array([x.max()]), np.array([h])]

    return _correlations(df, "set_id {kind}, h_max double, h_entropy double", finish, sigma, spectrum, chord_spectrum, resolution)


def virtual_pitches(df: DataFrame, sigma: float = 12.0, *, spectrum: SpectrumSpec = DEFAULT_TEMPLATE, chord_spectrum: SpectrumSpec | None = None, resolution: float = 1.0) -> DataFrame:
    """(set_id, vp_p, vp_w): the correlation as a profile over candidate fundamentals."""

    def finish(p0: float, x: np.ndarray, n: int) -> list[np.ndarray]:
        return [(np.arange(len(x)) - (n - 1)) * resolution + p0, x]

    return _correlations(df, "set_id {kind}, vp_p double, vp_w double", finish, sigma, spectrum, chord_spectrum, resolution)


def profile_native(df: DataFrame, sigma: float, spectrum: SpectrumSpec, chord_spectrum: SpectrumSpec | None, resolution: float) -> DataFrame:
    """virtual_pitches by joins of grid points, for coarse grids: (set_id, lag, vp_p, vp_w)."""
    low = lowered(df)
    chord = add_spectra(low, chord_spectrum) if chord_spectrum else low
    most = chord.groupBy("set_id").agg((F.max("p") + F.lit(4 * sigma)).alias("most"))
    at = chord.join(most, "set_id").select("set_id", "p0", "p", "w", F.posexplode(steps_to(F.col("most"), resolution)).alias("i", "x"))
    d = F.col("p") - F.col("x")
    values = at.groupBy("set_id", "p0", "i").agg(F.sum(F.col("w") * F.exp(-d * d / (2 * sigma**2))).alias("c"))
    template = _on_grid(*_spectrum_arrays(spectrum), sigma, resolution)  # bounded by the template's range over the resolution
    cells = values.select("*", F.posexplode(F.array(*[F.lit(float(t)) for t in template])).alias("j", "t"))
    lags = cells.groupBy("set_id", "p0", (F.col("i") - F.col("j")).alias("lag")).agg(F.sum(F.col("c") * F.col("t")).alias("x"))
    norm = values.groupBy("set_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c")) * F.lit(float((template**2).sum()))).alias("norm"))
    return lags.join(norm, "set_id").select("set_id", "lag", (F.col("lag") * F.lit(float(resolution)) + F.col("p0")).alias("vp_p"), (F.col("x") / F.col("norm")).alias("vp_w"))


def over_distinct(moment: Callable[[tuple[int, ...]], np.ndarray], size: int) -> np.ndarray:
    """Sum over tuples of distinct elements of a product of one factor for each place.

    moment(places) is the sum over elements of the product of those places' factors. Tuples that repeat an element
    are taken out over the partitions of the places: a block of b places counts (-1)^(b-1) (b-1)!.
    """
    done: dict[int, np.ndarray] = {0: np.ones(())}
    for mask in range(1, 1 << size):
        first, rest = mask & -mask, mask ^ (mask & -mask)
        total, part = 0.0, rest
        while True:
            places = tuple(i for i in range(size) if (first | part) >> i & 1)
            b = len(places)
            total = total + (-1) ** (b - 1) * math.factorial(b - 1) * moment(places) * done[rest ^ part]
            if not part:
                break
            part = (part - 1) & rest
        done[mask] = total
    return done[(1 << size) - 1]


def chord_density(x: np.ndarray, offsets: np.ndarray, weights: np.ndarray, copies: int, sigma: float) -> float:
    """The relative density of a template of so many copies of each partial at a chord's intervals (x sorted, x[0] = 0).

    exp(-q / 2 sigma^2) is, up to a constant, the integral over a common shift t of a product of one Gaussian for each
    pitch, so the sum over tuples is an integral of products of sums over partials: the cost grows with the partials,
    not with their power. The trapezoid rule is exact to exp(-40) for Gaussians at this step.
    """
    k = len(x)
    step = sigma * math.pi * math.sqrt(2 / (40 * k))
    ends = offsets.min() - x.max() - 9 * sigma, offsets.max() + 9 * sigma
    t = np.arange(ends[0], ends[1] + step, step)
    near = [np.exp(-((offsets[:, None] - p - t) ** 2) / (2 * sigma**2)) for p in x]
    held: dict[tuple[int, ...], np.ndarray] = {}

    def moment(places: tuple[int, ...]) -> np.ndarray:
        if places not in held:
            product = near[places[0]]
            for i in places[1:]:
                product = product * near[i]
            held[places] = copies * (weights ** len(places) @ product)
        return held[places]

    return float(max(0.0, over_distinct(moment, k).sum() * step * math.sqrt(k / (2 * math.pi)) / sigma))


def tensor_harmonicity(df: DataFrame, sigma: float = 12.0, *, size: int | None = None, spectrum: SpectrumSpec = DEFAULT_TENSOR, duplicate: int = 0, normalize: str = "none") -> DataFrame:
    """(set_id, h): the density of a template's intervals at the chord's; weights of the chord play no part.

    The template is ``duplicate`` copies (0: as many as pitches) of one complex tone, of any number of partials. Chords
    of fewer than two pitches, or not of ``size`` pitches where it is given, have a null h.
    """
    if size is not None and size < 2:
        raise ValueError("at least two pitches are needed")
    if normalize not in ("none", "gaussian", "pdf"):
        raise ValueError(f"unknown normalisation {normalize}")
    offsets, weights = _spectrum_arrays(spectrum)
    kind = dict(df.dtypes)["set_id"]

    def scale(k: int) -> float:
        if normalize == "none":
            return 1.0
        gaussian = (2 * math.pi * sigma**2) ** (-(k - 1) / 2) * math.sqrt(1 / k)
        mass = over_distinct(lambda places: (duplicate or k) * (weights ** len(places)).sum(), k) if normalize == "pdf" else 1.0
        return gaussian / float(mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for elems in batch.column("elems").to_pylist():
                p = np.sort([e["p"] for e in elems])
                right = len(p) == size if size else len(p) > 1
                values.append(chord_density(p - p[0], offsets, weights, duplicate or len(p), sigma) * scale(len(p)) if right else None)
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(values, pa.float64())], ["set_id", "h"])

    return one_row_each(df).mapInArrow(run, f"set_id {kind}, h double")


def roughness(df: DataFrame, *, p_norm: float = 1.0, average: bool = False, on_invalid: str = "raise") -> DataFrame:
    """(set_id, roughness) of partials in Hz: pairs of distinct frequencies; average divides by all pairs, unisons too.

    A frequency that is null or not positive raises, or with on_invalid="null" its set has no row. Sets are gathered by
    one shuffle and paired in their row.
    """
    valid = F.coalesce(F.col("p") > 0, F.lit(False))
    f = df.select("set_id", checked(F.col("p"), valid, "frequencies must be positive", on_invalid).alias("p"), "w")
    sets = f.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("p", "w"))).alias("elems"), F.count_if(F.col("p").isNull()).alias("bad")).where("bad = 0")
    each = sets.select("set_id", F.size("elems").alias("k"), "elems", F.explode("elems").alias("x"))
    pairs = each.select("set_id", "k", "x", F.explode_outer(F.filter("elems", lambda y: y["p"] > F.col("x")["p"])).alias("y"))
    gap = F.col("y.p") - F.col("x.p")
    #: fixed values of the dissonance curve
    s = F.lit(0.24) / (0.0207 * F.col("x.p") + 18.96)
    x = F.least("x.w", "y.w") * 5 * (F.exp(-3.51 * s * gap) - F.exp(-5.75 * s * gap))
    x = F.when(gap > 0, x if p_norm == 1 else F.pow(x, F.lit(float(p_norm))))
    t = F.coalesce(F.sum(x), F.lit(0.0))
    value = t if p_norm == 1 else F.pow(t, F.lit(1.0 / p_norm))
    summed = pairs.groupBy("set_id").agg(value.alias("value"), F.max("k").alias("k"))
    value = F.col("value")
    if average:
        value = F.when(F.col("k") > 1, value / (F.col("k") * (F.col("k") - 1) / 2)).otherwise(F.lit(0.0))
    return summed.select("set_id", value.alias("roughness"))
