"""Resample and repair (RSM-1..5) and table audits (AGG-1, AGG-2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsdrift.config import OUTLIER_FACTOR, OUTLIER_QUANTILE
from tsdrift.functions.timecols import epoch_micros, from_epoch_micros
from tsdrift.operators.prefix import fill_neighbours
from tsdrift.operators.quantiles import exact_quantiles

HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS
DEFAULT_BLOCK = 4096
KEY = ("series_id",)


def step_number(ts: str, every_micros: int):
    return F.floor(epoch_micros(ts) / F.lit(every_micros)).cast("bigint")


def resample_mean(df: DataFrame, every_micros: int = HOUR_MICROS, by: Sequence[str] = KEY,
                  ts: str = "ts", value: str = "value") -> DataFrame:
    """RSM-1: mean per fixed bucket, nulls skipped, labelled by bucket start.
    Partial aggregation runs map-side, so a hot series is pre-reduced before the
    shuffle."""
    step = step_number(ts, every_micros)
    return (df.groupBy(*by, step.alias("_step"))
              .agg(F.avg(value).alias("value"))
              .select(*by, from_epoch_micros(F.col("_step") * F.lit(every_micros)).alias("ts"), "value"))


def complete_grid(df: DataFrame, every_micros: int = HOUR_MICROS, by: Sequence[str] = KEY,
                  ts: str = "ts", value: str = "value", block: int = DEFAULT_BLOCK) -> DataFrame:
    """RSM-2: every bucket between each series' first and last one; missing
    buckets get a null value.  The grid is generated in two explodes (blocks,
    then steps inside a block) so a long series is spread over many tasks."""
    d = df.withColumn("_step", step_number(ts, every_micros))
    rng = d.groupBy(*by).agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    blocks = rng.select(*by, "_lo", "_hi",
                        F.explode(F.sequence(F.floor(F.col("_lo") / block),
                                             F.floor(F.col("_hi") / block))).alias("_b"))
    blocks = blocks.repartition(*by, "_b")
    grid = blocks.select(*by, F.explode(F.sequence(
        F.greatest(F.col("_lo"), F.col("_b") * block),
        F.least(F.col("_hi"), F.col("_b") * block + block - 1))).alias("_step"))
    out = grid.join(d.select(*by, "_step", value), [*by, "_step"], "left")
    return out.select(*by, from_epoch_micros(F.col("_step") * F.lit(every_micros)).alias(ts), value)


def interpolate_linear(df: DataFrame, every_micros: int = HOUR_MICROS, by: Sequence[str] = KEY,
                       ts: str = "ts", value: str = "value", block: int = DEFAULT_BLOCK,
                       max_gap: int | None = None) -> DataFrame:
    """RSM-3: linear interpolation by position on a complete grid; leading nulls
    stay null, trailing nulls take the last value.  No gap limit by default; with
    ``max_gap`` a run of more missing steps than that stays null whole."""
    d = df.withColumn("_pos", step_number(ts, every_micros))
    d = fill_neighbours(d, by, "_pos", value, block)
    prev_p, prev_v = F.col("_prev.p"), F.col("_prev.v")
    next_p, next_v = F.col("_next.p"), F.col("_next.v")
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
               .when(F.col("_prev").isNull(), F.lit(None).cast("double"))
               .when(F.col("_next").isNull(), prev_v)
               .otherwise(prev_v + (next_v - prev_v) * (F.col("_pos") - prev_p) / (next_p - prev_p)))
    if max_gap is not None:
        # the run after the last known value is as long as its last step says
        d = d.join(d.groupBy(*by).agg((F.max("_pos") + 1).alias("_end")), list(by))
        filled = F.when(F.col(value).isNotNull() | (F.coalesce(next_p, "_end") - prev_p - 1 <= max_gap), filled)
    return d.withColumn(value, filled).drop("_prev", "_next", "_pos", "_end")


def outlier_bounds(df: DataFrame, by: Sequence[str] = KEY, value: str = "value",
                   q: float = OUTLIER_QUANTILE, factor: float = OUTLIER_FACTOR,
                   approx: bool = False, fit_on: Column | None = None) -> DataFrame:
    """Per-series cap = factor * quantile(q) over all non-null values, or those of
    the rows where ``fit_on`` holds (the training period, say).  Exact
    linear-interpolated quantile by default (see ``operators.quantiles``); ``approx``
    uses a mergeable sketch alone."""
    df = df if fit_on is None else df.where(fit_on)
    if approx:
        return df.groupBy(*by).agg((F.percentile_approx(value, q, 10000) * F.lit(factor)).alias("upper_bound"))
    qs = exact_quantiles(df, by, value, [q])
    return qs.select(*by, (F.col("q")[0] * F.lit(factor)).alias("upper_bound"))


def cap_outliers(df: DataFrame, by: Sequence[str] = KEY, value: str = "value",
                 q: float = OUTLIER_QUANTILE, factor: float = OUTLIER_FACTOR,
                 approx: bool = False, keep_bound: bool = False, fit_on: Column | None = None) -> DataFrame:
    """RSM-4: values above the series bound are set to the bound.  A series without
    a row to fit on has no bound and stays as it is."""
    bounds = outlier_bounds(df, by, value, q, factor, approx, fit_on)
    out = (df.join(bounds, list(by), "left")
             .withColumn(value, F.when(F.col(value) > F.col("upper_bound"), F.col("upper_bound"))
                         .otherwise(F.col(value))))
    return out if keep_bound else out.drop("upper_bound")


def repair_audit(grid: DataFrame, by: Sequence[str] = KEY, ts: str = "ts", value: str = "value",
                 every_micros: int = HOUR_MICROS, q: float = OUTLIER_QUANTILE,
                 factor: float = OUTLIER_FACTOR) -> DataFrame:
    """RSM-5: per series, nulls before and after filling, values above the cap
    and the cap itself."""
    d = interpolate_linear(grid.withColumn("_f", F.col(value)), every_micros, by, ts, "_f")
    bounds = outlier_bounds(d, by, "_f", q, factor)
    return (d.join(bounds, list(by))
             .groupBy(*by, "upper_bound")
             .agg(F.count_if(F.col(value).isNull()).alias("missing_before"),
                  F.count_if(F.col("_f").isNull()).alias("missing_after"),
                  F.count_if(F.col("_f") > F.col("upper_bound")).alias("capped_count")))


def null_audit(df: DataFrame) -> DataFrame:
    """AGG-1: null count per column, long form (column_name, null_count)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, null_count)")


def require_complete(df: DataFrame) -> DataFrame:
    """Raise if any column holds a null (a split must be complete)."""
    bad = [r["column_name"] for r in null_audit(df).where("null_count > 0").collect()]
    if bad:
        raise ValueError(f"null values in columns: {bad}")
    return df


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-2: rows per value, most frequent first."""
    return (df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(*by, F.desc("n"), col))
