"""Multisets of the star-schema tables, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_profiles(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """Value by hour of day, for each user or event type: a multiset on a cycle of 24."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col(key).alias("set_id"), F.hour("ts").alias("p")).agg(F.sum("value").alias("w")).select("set_id", F.col("p").cast("double").alias("p"), "w")


def part_classes(spark: SparkSession, sf_dir: str, unit: float = 1.0) -> DataFrame:
    """Quantity by part number modulo 12, for each order: a multiset on a cycle of 12 units."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("set_id"), (F.col("l_partkey") % 12).alias("p")).agg(F.sum("l_quantity").alias("w")).select("set_id", (F.col("p") * F.lit(float(unit))).alias("p"), "w")


def value_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values above 0 as frequencies, for each user and event type, with weight 1; others are no frequency."""
    return read(spark, sf_dir, "events").where("value > 0").select(F.concat_ws("/", "user_id", "event_type").alias("set_id"), F.col("value").alias("p"), F.lit(1.0).alias("w"))
