"""Feature operators: projections (PRJ-3..8), lags and rolling frames
(WIN-1..3, WIN-5, WIN-6) and FLT-1.

Lags and rolling statistics are row-based frames on a complete hourly grid, so
position = hour number.  They are computed in one windowed pass over
``(series, block)`` partitions with a halo of ``max(lag, frame - 1)`` rows
copied from the previous block: no exchange ever puts a whole series in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.config import FEATURE_ORDER, HOLIDAYS, LAG_HOURS, ROLL_HOURS
from tsdrift.functions.calendar import day_of_week, is_weekend, season
from tsdrift.operators.prefix import BLOCK, OWN, block_window, with_halo
from tsdrift.operators.resample import DEFAULT_BLOCK, HOUR_MICROS, KEY, step_number


def project_target(df: DataFrame, ts: str, value: str, by: Sequence[str] = KEY,
                   target: str = "value") -> DataFrame:
    """PRJ-3: keep the key, the time and the renamed target only."""
    return df.select(*by, F.col(ts).alias("ts"), F.col(value).alias(target))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """PRJ-4/5/6: hour, day of week (Mon=0), day of month, month, weekend
    flag and season, all native expressions."""
    return (df.withColumn("hour_of_day", F.hour(ts))
              .withColumn("day_of_week", day_of_week(ts))
              .withColumn("day_of_month", F.dayofmonth(ts))
              .withColumn("month", F.month(ts))
              .withColumn("is_weekend", is_weekend(ts))
              .withColumn("season", season(F.month(ts))))


def holiday_table(spark, dates: Sequence[str] = HOLIDAYS) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("holiday_date"))


def holiday_rule_flag(df: DataFrame, month_days: Sequence[tuple[int, int]], ts: str = "ts") -> DataFrame:
    """PRJ-7 for holidays fixed by month and day in every year: an ``IN`` set."""
    day = F.month(ts) * 100 + F.dayofmonth(ts)
    return df.withColumn("is_holiday", day.isin([m * 100 + d for m, d in month_days]).cast("int"))


def holiday_flag(df: DataFrame, holidays: DataFrame | Sequence[str] = HOLIDAYS, ts: str = "ts") -> DataFrame:
    """PRJ-7: 1 when the calendar date of ``ts`` is a holiday.

    A literal list becomes an ``IN`` set; a holiday table is joined on the date
    (the planner broadcasts it if its size allows)."""
    day = F.to_date(ts)
    if not isinstance(holidays, DataFrame):
        return df.withColumn("is_holiday", day.isin(list(holidays)).cast("int"))
    dim = holidays.select(F.col(holidays.columns[0]).cast("date").alias("_hd")).distinct()
    return (df.join(dim, day == F.col("_hd"), "left")
              .withColumn("is_holiday", F.col("_hd").isNotNull().cast("int"))
              .drop("_hd"))


def lag_rolling(df: DataFrame, value: str = "value", ts: str = "ts", by: Sequence[str] = KEY,
                lags: Sequence[int] = LAG_HOURS, rolls: Sequence[int] = (ROLL_HOURS,),
                every_micros: int = HOUR_MICROS, block: int = DEFAULT_BLOCK,
                prefix: str = "load", exclude_current: bool = False) -> DataFrame:
    """WIN-1/2/3 in one pass: ``{prefix}_lag_{k}h`` = value k rows earlier;
    ``{prefix}_roll_mean_{w}h`` / ``_roll_std_{w}h`` = mean / sample std of the
    last w rows including the current one (excluding it if asked), null until
    all w values are present.  Input must be a complete grid."""
    halo = max([*lags, *[w - 1 + int(exclude_current) for w in rolls], 0])
    d = with_halo(df.withColumn("_pos", step_number(ts, every_micros)), "_pos", block, halo)
    w = block_window(by, "_pos")
    cols = {}
    for k in lags:
        prev = F.lag(value, k).over(w)
        gap = F.col("_pos") - F.lag("_pos", k).over(w)
        cols[f"{prefix}_lag_{k}h"] = F.when(gap == k, prev)
    for n in rolls:
        hi = -1 if exclude_current else 0
        frame = w.rowsBetween(hi - n + 1, hi)
        full = (F.count(value).over(frame) == n) & ((F.col("_pos") - F.min("_pos").over(frame)) == n - 1 - hi)
        cols[f"{prefix}_roll_mean_{n}h"] = F.when(full, F.avg(value).over(frame))
        cols[f"{prefix}_roll_std_{n}h"] = F.when(full, F.stddev_samp(value).over(frame))
    return d.withColumns(cols).where(F.col(OWN)).drop("_pos", BLOCK, OWN)


def smooth_rolling(df: DataFrame, value: str, order: str, keys: Sequence[str],
                   window: int, out: str) -> DataFrame:
    """WIN-5: mean of up to ``window`` rows ending at the current one
    (partial frames allowed).  Used on per-run metric tables whose key bounds
    the partition (windows of one run)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def running_min_before(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str],
                       out: str = "best_before") -> DataFrame:
    """WIN-6: smallest value among strictly earlier rows (null for the first)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.min(value).over(w))


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("load", "scenario")) -> list[str]:
    """PRJ-8: the feature set is every column except the target and label
    (and the keys / bookkeeping columns of this library)."""
    skip = set(exclude) | {"series_id", "ts", "split", "window_id", "pos"}
    return [c for c in df.columns if c not in skip]


def split_features_target(df: DataFrame, target: str = "load",
                          order: Sequence[str] = FEATURE_ORDER) -> tuple[DataFrame, DataFrame]:
    """PRJ-8: (features, target) frames sharing the (series_id, ts) key: every
    column but the target, the label and the keys, known features first in the
    training order."""
    known = [c for c in order if c in df.columns]
    feats = known + [c for c in feature_columns(df, (target, "scenario")) if c not in known]
    return df.select("series_id", "ts", *feats), df.select("series_id", "ts", target)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """FLT-1: drop rows with any null."""
    return df.na.drop("any")


def build_features(series: DataFrame, holidays=HOLIDAYS, by: Sequence[str] = KEY,
                   block: int = DEFAULT_BLOCK) -> DataFrame:
    """Hourly repaired series (series_id, ts, value) -> the 12-feature table
    with target ``load``, incomplete rows dropped."""
    d = lag_rolling(series, "value", "ts", by, block=block)
    d = holiday_flag(calendar_features(d), holidays)
    d = d.withColumnRenamed("value", "load")
    cols = [*by, "ts", "load", *FEATURE_ORDER]
    return drop_incomplete(d.select(*cols))
