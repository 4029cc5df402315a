"""Canonical series derived from the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings keyed by event type: (series_id, ts, value)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series_id"), "ts", "value")


def user_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series keyed by user: (series_id, ts, value)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("series_id"), "ts", "value")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value per priority: (series_id, ts, value) readings."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("series_id"),
                    F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))


def lineitem_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship-dated prices per return flag: the largest sample for PSI."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
                     F.col("l_extendedprice").cast("double").alias("value"))
