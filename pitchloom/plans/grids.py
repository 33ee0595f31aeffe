"""Query grids as array Columns, to be exploded beside each set: no table and no join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def integers(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double"))


def linspace(first: float, last: float, n: int, endpoint: bool = True) -> Column:
    step = (last - first) / ((n - 1 if endpoint else n) or 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(first)) + i * F.lit(step))


def steps_to(most: Column, resolution: float) -> Column:
    """0, resolution, 2 resolution, ... below most + resolution; the bound may differ by set."""
    n = F.ceil((most + resolution) / resolution).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(float(resolution)))


def points(xs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])
