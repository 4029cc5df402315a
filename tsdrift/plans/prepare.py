"""Raw events -> hourly series -> repaired series -> labelled feature table.

One lazy plan: RSM-1 -> RSM-2 -> RSM-3 -> RSM-4 -> WIN-1..3 / PRJ-4..7 ->
FLT-1 -> FLT-2 -> FLT-3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsdrift.config import HOLIDAYS, HOURLY_SPLIT, SplitConfig
from tsdrift.operators.features import build_features
from tsdrift.operators.resample import (
    DEFAULT_BLOCK, cap_outliers, complete_grid, interpolate_linear, resample_mean,
)
from tsdrift.operators.scenarios import chronological_split, label_scenarios
from tsdrift.session import materialize as write_table
from tsdrift.sources.fixtures import event_readings


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_mean(event_readings(spark, sf_dir))


def hourly_grid(spark: SparkSession, sf_dir: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """The complete grid of the hourly series, which is written once: the steps
    from here on read their input several times."""
    return complete_grid(write_table(hourly_series(spark, sf_dir), "hourly"), block=block)


def hourly_filled(spark: SparkSession, sf_dir: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    return interpolate_linear(hourly_grid(spark, sf_dir, block), block=block)


def hourly_repaired(spark: SparkSession, sf_dir: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    return cap_outliers(hourly_filled(spark, sf_dir, block))


def labelled(features: DataFrame, cfg: SplitConfig) -> DataFrame:
    return label_scenarios(chronological_split(features, cfg), cfg)


def hourly_features(spark: SparkSession, sf_dir: str, cfg: SplitConfig = HOURLY_SPLIT,
                    holidays=HOLIDAYS, block: int = DEFAULT_BLOCK, materialize: bool = True) -> DataFrame:
    """The labelled feature table of the event fixture.

    The raw events are reduced to hourly means first and, by default, that
    small table is written once to the shared checkpoint folder: the repair
    steps read their input several times (grid range, gap join, fill carry,
    outlier bound), and re-reading the raw events for each would multiply the
    largest scan."""
    hourly = hourly_series(spark, sf_dir)
    if materialize:
        hourly = write_table(hourly, "hourly")
    repaired = cap_outliers(interpolate_linear(complete_grid(hourly, block=block), block=block))
    feats = build_features(repaired, holidays, block=block)
    return labelled(feats, cfg)


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per priority and day."""
    from tsdrift.operators.resample import DAY_MICROS
    from tsdrift.sources.fixtures import daily_orders

    return resample_mean(daily_orders(spark, sf_dir), DAY_MICROS)


def order_features(spark: SparkSession, sf_dir: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Hourly feature table over several years: mean order value in thousands per
    priority and day, interpolated to hours."""
    from pyspark.sql import functions as F

    from tsdrift.config import DAILY_SPLIT

    daily = write_table(daily_series(spark, sf_dir).withColumn("value", F.col("value") / 1000), "daily")
    filled = interpolate_linear(complete_grid(daily, block=block), block=block)
    return labelled(build_features(cap_outliers(filled), HOLIDAYS, block=block), DAILY_SPLIT)


def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsdrift.config import DAILY_SPLIT, HOLIDAY_MONTH_DAYS
    from tsdrift.operators.features import calendar_features, holiday_rule_flag

    d = holiday_rule_flag(calendar_features(daily_series(spark, sf_dir)), HOLIDAY_MONTH_DAYS)
    return labelled(d, DAILY_SPLIT)
