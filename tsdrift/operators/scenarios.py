"""Splits, scenario labels and scoring windows (FLT-2..6, WIN-0, WIN-4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.config import ScenarioRule, SplitConfig
from tsdrift.functions.timecols import ntz
from tsdrift.operators import prefix

KEY = ("series_id",)


def chronological_split(df: DataFrame, cfg: SplitConfig, ts: str = "ts") -> DataFrame:
    """FLT-2: ``split`` = train (< val_start), val ([val_start, test_start)),
    test (>= test_start)."""
    t = F.col(ts)
    return df.withColumn("split", F.when(t < ntz(cfg.val_start), "train")
                                   .when(t < ntz(cfg.test_start), "val")
                                   .otherwise("test"))


def rule_condition(rule: ScenarioRule, ts: str = "ts") -> Column:
    t = F.col(ts)
    cond = F.lit(True)
    if rule.months is not None:
        cond = cond & F.month(t).isin(list(rule.months))
    if rule.year is not None:
        cond = cond & (F.year(t) == rule.year)
    if rule.start is not None:
        cond = cond & (t >= ntz(rule.start))
    if rule.end is not None:
        cond = cond & (t <= ntz(rule.end))
    return cond


def label_scenarios(df: DataFrame, cfg: SplitConfig, ts: str = "ts") -> DataFrame:
    """FLT-3: ordered rules, the last matching rule wins; only test rows get
    a scenario, other rows keep null."""
    label = F.lit(cfg.default_scenario)
    for rule in cfg.rules:  # later rules wrap earlier ones: last match wins
        label = F.when(rule_condition(rule, ts), F.lit(rule.name)).otherwise(label)
    return df.withColumn("scenario", F.when(F.col("split") == "test", label))


def filter_scenario(df: DataFrame, name: str | None) -> DataFrame:
    """FLT-4: rows of one scenario; None (or no scenario column) keeps all
    rows; an unknown name gives an empty result."""
    if name is None or "scenario" not in df.columns:
        return df
    return df.where(F.col("scenario") == name)


def row_position(df: DataFrame, keys: Sequence[str] = KEY, ts: str = "ts",
                 out: str = "pos", tiebreak: Sequence[str] = ()) -> DataFrame:
    """WIN-0: 0-based position in time order (then ``tiebreak``) within ``keys``,
    by range partitioning: the row rate of a series does not matter."""
    return prefix.range_positions(df, keys, [ts, *tiebreak], out)


def split_at_fraction(df: DataFrame, fraction: float = 0.5, keys: Sequence[str] = KEY,
                      ts: str = "ts") -> DataFrame:
    """FLT-5: ``part`` = 'first' for positions below floor(n * fraction)."""
    d = row_position(df, keys, ts, "_p")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (d.join(n, list(keys))
             .withColumn("part", F.when(F.col("_p") < F.floor(F.col("_n") * fraction), "first")
                         .otherwise("second"))
             .drop("_p", "_n"))


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """FLT-6: the last ``n`` rows in time per key (a top-k: the limit is the
    operator).  Window rank with a pushed-down limit per partition."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def forecast_windows(df: DataFrame, size: int, step: int, keys: Sequence[str] = ("series_id", "scenario"),
                     ts: str = "ts") -> DataFrame:
    """WIN-4: row-count windows starting at positions 0, step, 2*step, ...
    Windows overlap when step < size (rows are repeated, at most
    ceil(size/step) times) and leave rows out when step > size.  The short
    last window is kept.  ``window_start`` is the time of the window's first
    row; positions are counted after any scenario filter."""
    d = row_position(df, keys, ts, "pos")
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.lit(size - 1)) / F.lit(step)))
    hi = F.floor(F.col("pos") / F.lit(step))
    if size == step:
        d = d.withColumn("window_id", hi.cast("bigint"))
    else:
        d = (d.where(lo <= hi)
              .withColumn("window_id", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint")))))
    w = Window.partitionBy(*keys, "window_id")
    return d.withColumn("window_start", F.min(ts).over(w))
