"""Expectation tensors: Gaussian mixtures over the ordered tuples of a multiset.

A set's elements are gathered in one row (one shuffle), and its tuples never leave that row's partition. A density's are
exploded there and summed under the same key; an inner product's are arrays in an Arrow batch (kernels.py), which took a
tenth of the time of exploded rows. A set's norm is computed once, however many pairs it is in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import density_form, wrap
from ..model import SpectrumSpec, TensorParams, nested, one_row_each
from .kernels import Literal, Ragged, inner
from .spectra import add_spectra

PDF, GAUSSIAN, NONE = "pdf", "gaussian", "none"


def row_tuples(rows: DataFrame, r: int, ordered: bool) -> DataFrame:
    """Rows with an array elems of (p, w), exploded to tuples: the other columns, u1..ur, i1..ir (places) and w."""
    if r < 1:
        raise ValueError("r must be at least 1")
    others = [c for c in rows.columns if c != "elems"]
    out = rows
    for k in range(1, r + 1):
        before = [c for j in range(1, k) for c in (f"u{j}", f"i{j}", f"w{j}")]
        out = out.select(*others, "elems", *before, F.posexplode("elems").alias(f"i{k}", "e"))
        out = out.select(*others, "elems", *before, F.col("e.p").alias(f"u{k}"), f"i{k}", F.col("e.w").alias(f"w{k}"))
        for j in range(1, k) if ordered else range(max(1, k - 1), k):
            out = out.where(f"i{j} <> i{k}" if ordered else f"i{j} < i{k}")
    weight = F.lit(1.0)
    for k in range(1, r + 1):
        weight = weight * F.col(f"w{k}")
    return out.select(*others, *[f"u{k}" for k in range(1, r + 1)], *[f"i{k}" for k in range(1, r + 1)], weight.alias("w"))


def tuples(df: DataFrame, r: int, ordered: bool) -> DataFrame:
    """(set_id, u1..ur, w): combinations, or all ordered tuples; sets of fewer than r elements have none."""
    if r == 1:
        return df.select("set_id", F.col("p").alias("u1"), "w")
    return row_tuples(nested(df), r, ordered).select("set_id", *[f"u{k}" for k in range(1, r + 1)], "w")


def build(df: DataFrame, t: TensorParams) -> DataFrame:
    """Centres (set_id, c1..c_dim, w) of the mixture; relative tensors take the differences to the first element."""
    u = tuples(df, t.r, True)
    centres = [F.col(f"u{k}") - F.col("u1") for k in range(2, t.r + 1)] if t.relative else [F.col(f"u{k}") for k in range(1, t.r + 1)]
    return u.select("set_id", *[c.alias(f"c{k}") for k, c in enumerate(centres, 1)], "w")


def evaluate(density: DataFrame, grid: Column, t: TensorParams, normalize: str = NONE) -> DataFrame:
    """(set_id, x, value) of a density of build() at the points of a grid.

    The grid is an array Column: of doubles where dim is 1, else of arrays of dim doubles. normalize: none, gaussian
    (each kernel integrates to 1) or pdf (the whole does; null where the weights have no positive sum).
    """
    if normalize not in (NONE, GAUSSIAN, PDF):
        raise ValueError(f"unknown normalisation {normalize}")
    at = density.select("*", F.explode(grid).alias("x"))
    d = [F.col(f"c{k}") - (F.col("x") if t.dim == 1 else F.col("x")[k - 1]) for k in range(1, t.dim + 1)]
    value = F.sum(F.col("w") * F.exp(-density_form(d, t) / (2 * t.sigma**2)))
    scale = 1.0
    if normalize != NONE:
        scale = (2 * math.pi * t.sigma**2) ** (-t.dim / 2) * math.sqrt(1 / t.r if t.relative else 1.0)
    value = value * F.lit(scale)
    if normalize == PDF:
        value = value / F.nullif(F.sum("w"), F.lit(0.0))
    return at.groupBy("set_id", "x").agg(value.alias("value"))


def evaluate_raw(df: DataFrame, grid: Column, t: TensorParams, normalize: str = NONE) -> DataFrame:
    return evaluate(build(df, t), grid, t, normalize)


def inner_sums(rows: DataFrame, keys: Sequence[str], sums: dict[str, tuple[str, str | Literal]], t: TensorParams, same: str | None = None) -> DataFrame:
    """The key columns, and for each name the inner product of two array columns of (p, w) (or one and a literal).

    Null where either side has fewer than r elements. Rows of equal sizes are computed together in an Arrow batch; of
    neighbours that agree in the column ``same``, the first alone.
    """
    kinds = dict(rows.dtypes)
    columns = list(dict.fromkeys(c for pair in sums.values() for c in pair if isinstance(c, str)))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} double" for n in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(same) if same else None
            new = np.r_[True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)] if same else np.ones(batch.num_rows, bool)
            firsts = pa.array(np.flatnonzero(new))
            sets = {c: Ragged.of(batch.column(c).take(firsts)) for c in columns}
            found = [inner(sets[x], sets[y] if isinstance(y, str) else y.repeated(len(firsts)), t)[np.cumsum(new) - 1] for x, y in sums.values()]
            values = [pa.array(v, mask=np.isnan(v)) for v in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *values], [*keys, *sums])

    needed = dict.fromkeys([*keys, *columns, *([same] if same else [])])
    return rows.select(*needed).mapInArrow(run, schema)


def ratio(ip: Column, na: Column, nb: Column) -> Column:
    return F.when((na > 0) & (nb > 0), ip / F.sqrt(na * nb))


def cosine(left: DataFrame, right: DataFrame, pairs: DataFrame, t: TensorParams) -> DataFrame:
    """(a_id, b_id, similarity); null where a set has fewer than r elements or no weight."""
    a, b = (inner_sums(one_row_each(df), ["set_id", "elems"], {"norm": ("elems", "elems")}, t) for df in (left, right))
    both = pairs.join(a.toDF("a_id", "ea", "na"), "a_id").join(b.toDF("b_id", "eb", "nb"), "b_id")
    met = inner_sums(both, ["a_id", "b_id", "na", "nb"], {"ip": ("ea", "eb")}, t)
    found = met.select("a_id", "b_id", ratio(F.col("ip"), F.col("na"), F.col("nb")).alias("similarity"))
    return pairs.join(found, ["a_id", "b_id"], "left").select("a_id", "b_id", "similarity")


def cosine_with(df: DataFrame, name: str, ps: Sequence[float], t: TensorParams, ws: Sequence[float] | None = None) -> DataFrame:
    """cosine() of every set of df with one literal set, whose b_id is name: one scan, one gathering shuffle, no join."""
    there = Literal(np.array(ps, float), np.ones(len(ps)) if ws is None else np.array(ws, float))
    norm = inner(there.repeated(1), there.repeated(1), t)[0]
    met = inner_sums(one_row_each(df), ["set_id"], {"ip": ("elems", there), "na": ("elems", "elems")}, t)
    similarity = ratio(F.col("ip"), F.col("na"), F.lit(float(norm)))
    return met.select(F.col("set_id").alias("a_id"), F.lit(name).alias("b_id"), similarity.alias("similarity"))


def cosine_of_rows(rows: DataFrame, keys: Sequence[str], t: TensorParams, same: str | None = None) -> DataFrame:
    """(keys, similarity) of rows with arrays ea and eb of (p, w): no shuffle."""
    met = inner_sums(rows, keys, {"ip": ("ea", "eb"), "na": ("ea", "ea"), "nb": ("eb", "eb")}, t, same)
    return met.select(*keys, ratio(F.col("ip"), F.col("na"), F.col("nb")).alias("similarity"))


def cosine_absolute_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, t: TensorParams) -> DataFrame:
    """cosine() for absolute tensors of r = 2, without their tuples.

    With A_ik = w_i v_k exp(-d_ik^2 / 4 sigma^2), twice the inner product is S^2 - sum of squared row sums - sum of
    squared column sums + sum of squares; so n m kernels do instead of n^2 m^2, all in the row of a pair.
    """
    if t.relative or t.r != 2:
        raise ValueError("this form is of absolute tensors of r = 2")

    def cell(x: Column, y: Column) -> Column:
        d = x["p"] - y["p"]
        d = wrap(d, t.period) if t.periodic else d
        return x["w"] * y["w"] * F.exp(-d * d / (4 * t.sigma**2))

    def total(xs: Column, f) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))

    def twice(a: str, b: str) -> Column:
        rows = F.transform(F.col(a), lambda x: total(F.col(b), lambda y: cell(x, y)))
        columns = F.transform(F.col(b), lambda y: total(F.col(a), lambda x: cell(x, y)))
        s = total(rows, lambda x: x)
        squares = total(F.col(a), lambda x: total(F.col(b), lambda y: cell(x, y) * cell(x, y)))
        return s * s - total(rows, lambda x: x * x) - total(columns, lambda x: x * x) + squares

    a, b = (nested(df).select("set_id", "elems", twice("elems", "elems").alias("norm")) for df in (left, right))
    out = pairs.join(a.toDF("a_id", "ea", "na"), "a_id", "left").join(b.toDF("b_id", "eb", "nb"), "b_id", "left")
    enough = (F.size("ea") > 1) & (F.size("eb") > 1)
    return out.select("a_id", "b_id", F.when(enough, ratio(twice("ea", "eb"), F.col("na"), F.col("nb"))).alias("similarity"))


def entropy_of(values: DataFrame, base: float = 2.0, normalize: bool = True) -> DataFrame:
    """(set_id, entropy) of non-negative values (set_id, value), in one aggregate; 0 where they sum to 0.

    H = ln S - sum(t ln t) / S; the normaliser is the logarithm of the number of bins, empty ones too.
    """
    t = F.col("value")
    s, n = F.sum(t), F.count(t)
    h = (F.log(s) - F.sum(F.when(t > 0, t * F.log(t)).otherwise(0.0)) / s) / math.log(base)
    if normalize:
        h = F.when(n > 1, h / (F.log(n.cast("double")) / math.log(base)))
    return values.groupBy("set_id").agg(F.when(s > 0, h).otherwise(0.0).alias("entropy"))


def entropy_exp_tens(df: DataFrame, t: TensorParams, *, spectrum: SpectrumSpec | None = None, normalize: bool = True, base: float = 2.0, points: int = 1200, x_min: float | None = None, x_max: float | None = None) -> DataFrame:
    """(set_id, entropy) of the density on a grid; of tensors of one dimension."""
    from ..plans.grids import linspace

    if t.dim != 1:
        raise ValueError("the entropy is of tensors of one dimension")
    if not t.periodic and (x_min is None or x_max is None or x_min >= x_max):
        raise ValueError("bounds x_min < x_max are needed where the tensor is not periodic")
    grid = linspace(0, t.period, points, endpoint=False) if t.periodic else linspace(x_min, x_max, points)
    return entropy_of(evaluate_raw(add_spectra(df, spectrum) if spectrum else df, grid, t), base, normalize)
