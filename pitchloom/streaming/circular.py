"""Balance and centroid of an event stream, by tumbling windows: circular moments are sums, so the state is native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.circular import moments


def windowed_balance(events: DataFrame, time: str, key: str, position: Column, weight: Column, period: float, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, set_id, balance, centroid, total) of a streaming or static table; rows later than ``late`` are dropped."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    each = stamped.select("__t", F.col(key).alias("set_id"), position.cast("double").alias("p"), weight.cast("double").alias("w"))
    m = each.groupBy(F.window("__t", window).alias("window"), "set_id").agg(*moments(period))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return m.select("window", "set_id", (1 - size / F.nullif("total", F.lit(0.0))).alias("balance"), (F.pmod(F.atan2("im", "re"), F.lit(2 * math.pi)) * F.lit(period / (2 * math.pi))).alias("centroid"), "total")
