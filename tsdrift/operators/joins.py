"""Joins and set operations (JON-1..4, SET-1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.functions.timecols import epoch_micros

KEY = ("series_id",)
DAY_MICROS = 86_400_000_000


def train_plus_test_history(train: DataFrame, test: DataFrame) -> DataFrame:
    """SET-1: train rows followed by test rows, columns aligned by name
    (validation rows are not part of the refit history)."""
    return train.unionByName(test, allowMissingColumns=True)


def history_slice(candidates: DataFrame, history: DataFrame, days: float, by: Sequence[str] = KEY,
                  t: str = "t", ts: str = "ts") -> DataFrame:
    """JON-2: every history row with ``t - days <= ts <= t`` (both ends
    inclusive) for each candidate time ``t``.

    A range join made equi: each candidate is copied to the day buckets its
    range touches (ceil(days) + 1 copies: the small side), history rows keep
    one bucket, the join runs on (key, day) and the exact bound filters."""
    span = int(round(days * DAY_MICROS))
    lo_day = F.floor((epoch_micros(t) - F.lit(span)) / F.lit(DAY_MICROS))
    hi_day = F.floor(epoch_micros(t) / F.lit(DAY_MICROS))
    c = candidates.withColumn("_day", F.explode(F.sequence(lo_day, hi_day)))
    h = history.withColumn("_day", F.floor(epoch_micros(ts) / F.lit(DAY_MICROS)))
    lower = F.timestamp_add("MICROSECOND", F.lit(-span), F.col(t))
    return (c.join(h, [*by, "_day"])
             .where((F.col(ts) >= lower) & (F.col(ts) <= F.col(t)))
             .drop("_day"))


def asof_forward(events: DataFrame, metrics: DataFrame, keys: Sequence[str], t: str = "timestamp",
                 value: str = "mape") -> DataFrame:
    """JON-1: for each event, the metric of the first metric row at or after
    the event time; when there is none, the last metric row's value.

    Events and metrics are unioned per key and read backwards in time, so the next
    metric row is the last one seen and each row costs the same.  The partitions
    are runs (policy x scenario), whose windows are few."""
    m = metrics.select(*keys, F.col(t).alias("_t"), F.col(value).alias("_v"), F.lit(1).alias("_m"))
    e = events.select(*keys, F.col(t).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_m"))
    # backwards, a metric at the event time comes before the event, so it counts
    w = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_m").desc())
    metric = F.when(F.col("_m") == 1, F.struct("_t", "_v"))
    nxt = F.last(metric, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(metric).over(Window.partitionBy(*keys))
    return (m.unionByName(e)
             .withColumn("_next", nxt).withColumn("_last", last)
             .where(F.col("_m") == 0)
             .select(*keys, F.col("_t").alias(t), F.coalesce(F.col("_next._v"), F.col("_last._v")).alias(value)))


def paired_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str = "window_id",
                   value: str = "mape") -> DataFrame:
    """JON-3: pair two runs by window ordinal; the longer run is cut to the
    shorter one (inner join)."""
    extra = [c for c in b.columns if c == "other_policy"]
    return (a.select(*keys, pos, F.col(value).alias("a"))
             .join(b.select(*keys, *extra, pos, F.col(value).alias("b")), [*keys, pos]))


def experiment_grid(policies: Sequence[str], labelled: DataFrame) -> DataFrame:
    """JON-4: every policy (a literal list) with every scenario of ``labelled``."""
    scenarios = labelled.where(F.col("scenario").isNotNull()).select("scenario").distinct()
    return scenarios.select(F.explode(F.array(*[F.lit(p) for p in policies])).alias("policy"), "scenario")
