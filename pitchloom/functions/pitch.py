"""Pitch scales, periodic differences and kernels as Columns; all stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..model import SpectrumSpec, TensorParams

#: Each scale's conversion to and from Hz, as SQL over v and f.
TO_HZ = {
    "hz": "{v}",
    "midi": "440 * power(2, ({v} - 69) / 12)",
    "cents": "440 * power(2, ({v} - 6900) / 1200)",
    "mel": "700 * (power(10, {v} / 2595) - 1)",
    "bark": "1960 * ({v} + 0.53D) / (26.28D - {v})",
    "erb": "(power(10, {v} / 21.4D) - 1) / 0.00437D",
    "greenwood": "165.4D * (power(10, 2.1D * {v}) - 0.88D)",
}
FROM_HZ = {
    "hz": "{f}",
    "midi": "69 + 12 * log2({f} / 440)",
    "cents": "6900 + 1200 * log2({f} / 440)",
    "mel": "2595 * log10(1 + {f} / 700)",
    "bark": "26.81D / (1 + 1960 / {f}) - 0.53D",
    "erb": "21.4D * log10(0.00437D * {f} + 1)",
    "greenwood": "log10({f} / 165.4D + 0.88D) / 2.1D",
}


def _scale(name: str) -> str:
    if name.lower() not in TO_HZ:
        raise ValueError(f"unknown scale {name}; one of {', '.join(TO_HZ)}")
    return name.lower()


def conversion(column: str, source: str, target: str) -> str:
    """SQL text of a conversion of a named column; every pair of scales goes through Hz."""
    source, target = _scale(source), _scale(target)
    value = f"CAST({column} AS DOUBLE)"
    return value if source == target else FROM_HZ[target].format(f=f"({TO_HZ[source].format(v=value)})")


def convert_pitch(column: str, source: str, target: str) -> Column:
    """A named column's values from one of hz, midi, cents, mel, bark, erb, greenwood to another."""
    return F.expr(conversion(column, source, target))


def register(spark: SparkSession) -> list[str]:
    """SQL functions convert_<source>_to_<target>(v DOUBLE) in the session; their names."""
    names = []
    for source in TO_HZ:
        for target in FROM_HZ:
            names.append(f"convert_{source}_to_{target}")
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[-1]}(v DOUBLE) RETURNS DOUBLE RETURN {conversion('v', source, target)}")
    return names


def wrap(d: Column, period: float) -> Column:
    """The nearest periodic image of a difference, in [-period/2, period/2)."""
    half = period / 2
    reduced = F.pmod(d + F.lit(half), F.lit(float(period)))
    # pmod of a tiny negative rounds to the period itself
    return F.when(reduced >= period, F.lit(0.0)).otherwise(reduced) - F.lit(half)


def total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def similarity_form(d: Sequence[Column], t: TensorParams) -> Column:
    """The quadratic form of the inner product, of the differences of two tuples."""
    if t.relative and t.periodic:
        pairs = [wrap(d[i] - d[j], t.period) for i in range(t.r) for j in range(i + 1, t.r)]
        return total([x * x for x in pairs]) / t.r
    d = [wrap(x, t.period) for x in d] if t.periodic else list(d)
    squares = total([x * x for x in d])
    return squares - total(d) * total(d) / t.r if t.relative else squares


def density_form(d: Sequence[Column], t: TensorParams) -> Column:
    """The quadratic form of the density: component-wise differences, also where relative and periodic."""
    d = [wrap(x, t.period) for x in d] if t.periodic else list(d)
    squares = total([x * x for x in d])
    return squares - total(d) * total(d) / t.r if t.relative else squares


def partial_offset(n: Column, spec: SpectrumSpec) -> Column:
    """Offset of the n-th partial, in units per octave."""
    x, k = n.cast("double"), spec.parameter
    if spec.mode == "stretched":
        return F.lit(k * spec.units) * F.log2(x)
    if spec.mode == "freqlinear":
        return F.lit(spec.units) * F.log2((x + k) / F.lit(k + 1.0))
    if spec.mode == "stiff":
        return F.lit(spec.units) * F.log2(x * F.sqrt(1 + k * x * x) / F.lit((1 + k) ** 0.5))
    return F.lit(spec.units) * F.log2(x)


def partial_weight(n: Column, spec: SpectrumSpec) -> Column:
    x = n.cast("double")
    return F.pow(x, F.lit(-spec.rate)) if spec.decay == "powerlaw" else F.pow(F.lit(spec.rate), x - 1)


def partials(spec: SpectrumSpec) -> Column:
    """ARRAY<STRUCT<offset, weight>>, a literal of the plan."""
    if spec.mode == "custom":
        return F.array(*[F.struct(F.lit(float(o)).alias("offset"), F.lit(float(w)).alias("weight")) for o, w in zip(spec.offsets, spec.weights, strict=True)])
    return F.transform(F.sequence(F.lit(1), F.lit(int(spec.n))), lambda n: F.struct(partial_offset(n, spec).alias("offset"), partial_weight(n, spec).alias("weight")))
