"""Profiles: a value for each position of each set, such as a sweep of similarities or a spectrum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.audio import prominent


def gamma_compress(df: DataFrame, column: str, gamma: float, *keys: str) -> DataFrame:
    """df with the column's values put on [0, 1] by its least and greatest, raised to gamma, and put back.

    Within the keys; nulls stay null, and where all values are equal they stay as they are. Least and greatest come
    from one aggregate that is joined back, so no key is gathered in one task.
    """
    ends = df.groupBy(*keys).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    value = F.when(span > 0, F.pow((F.col(column) - F.col("__lo")) / span, F.lit(float(gamma))) * span + F.col("__lo")).otherwise(F.col(column))
    joined = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))  # without keys, ends is one row
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def above_floor(df: DataFrame, factor: float) -> DataFrame:
    """Rows (set_id, x, value) above so many times the median of their set's values."""
    floor = df.groupBy("set_id").agg(F.median("value").alias("__floor"))
    return df.join(floor, "set_id").where(F.col("value") > factor * F.col("__floor")).drop("__floor")


def spaced(x: np.ndarray, value: np.ndarray, spacing: float, most: int | None) -> list[int]:
    """Places from the greatest value down, each at least the spacing from those before it; ties by the lesser x."""
    out: list[int] = []
    for i in np.lexsort((x, -value)).tolist():
        if all(abs(x[i] - x[j]) >= spacing for j in out):
            out.append(i)
            if most and len(out) == most:
                break
    return out


def peaks(df: DataFrame, min_prominence: float, spacing: float = 0.0, most: int | None = None) -> DataFrame:
    """(set_id, rank, x, value): local maxima of the profiles (set_id, x, value) that stand out by min_prominence.

    The greatest come first, each at least the spacing from those kept; a profile is one row, in the order of x.
    """
    kind = dict(df.dtypes)["set_id"]
    rows = df.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("x", "value"))).alias("profile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, ranks, xs, values = [], [], [], []
            for key, profile in zip(batch.column("set_id").to_pylist(), batch.column("profile").to_pylist(), strict=True):
                x, y = np.array([e["x"] for e in profile], float), np.array([e["value"] for e in profile], float)
                at = prominent(y, min_prominence) if len(y) > 2 else np.zeros(0, int)
                for rank, i in enumerate(at[spaced(x[at], y[at], spacing, most)].tolist(), 1):
                    sets.append(key)
                    ranks.append(rank)
                    xs.append(float(x[i]))
                    values.append(float(y[i]))
            columns = [pa.array(sets, batch.schema.field("set_id").type), pa.array(ranks, pa.int32()), pa.array(xs, pa.float64()), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "rank", "x", "value"])

    return rows.mapInArrow(run, f"set_id {kind}, rank int, x double, value double")


