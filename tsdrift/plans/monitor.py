"""Shared plans over the hourly feature table: windows, model 0, static
signals, the backtest and its logs.  The feature table is materialised once
(checkpoint in the shared checkpoint folder) because every downstream plan
reads it several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsdrift.config import HOURLY_BACKTEST, HOURLY_DRIFT, HOURLY_POLICIES
from tsdrift.functions.timecols import epoch_micros
from tsdrift.operators import drift, models, policies
from tsdrift.operators.scenarios import forecast_windows
from tsdrift.plans import backtest, prepare
from tsdrift.session import materialize as write_table

WKEYS = ("scenario", "window_id")


def features(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    f = prepare.hourly_features(spark, sf_dir)
    if materialize:
        cols = f.columns
        f = write_table(f, "features", partition_by="split").select(*cols)
    return f


def windows(f: DataFrame) -> DataFrame:
    return forecast_windows(f.where(F.col("split") == "test"), HOURLY_BACKTEST.window_size, HOURLY_BACKTEST.step)


def static_scores(f: DataFrame) -> DataFrame:
    """Model 0 MAPE / RMSE per window and the series' baseline MAPE."""
    m0 = backtest.initial_model(f, HOURLY_BACKTEST)
    w = models.predict_linear(windows(f), m0, x=HOURLY_BACKTEST.x_col)
    ev = models.evaluate(w, HOURLY_BACKTEST.y_col, "prediction", by=["series_id", *WKEYS])
    start = w.groupBy("series_id", *WKEYS).agg(F.min("window_start").alias("window_start"))
    return (ev.join(start, ["series_id", *WKEYS])
              .join(m0.select("series_id", "baseline_mape"), "series_id"))


def static_monitor(f: DataFrame) -> DataFrame:
    """DRF-9 with the initial model: PSI, KS vote and MAPE ratio per window;
    overall drift = any of the three.  A series without a baseline (no validation
    rows) is compared with its first window."""
    d = drift.window_drift(f.where(F.col("split") == "train"), windows(f), HOURLY_DRIFT,
                           HOURLY_BACKTEST.y_col, window_keys=WKEYS, written=True)
    s = drift.mape_check(drift.with_baseline(static_scores(f), ["series_id", "scenario"]), alpha=HOURLY_DRIFT.mape_alpha, beta=HOURLY_DRIFT.mape_beta)
    out = s.join(d, ["series_id", *WKEYS], "left")
    overall = (F.coalesce(F.col("psi_drift"), F.lit(False)) | F.coalesce(F.col("ks_drift"), F.lit(False))
               | F.coalesce(F.col("mape_drift"), F.lit(False)))
    return out.withColumn("overall_drift", overall)


def static_policy_fires(f: DataFrame) -> DataFrame:
    """POL-0..4 over the initial model's window signals (no refits)."""
    sig = static_monitor(f).withColumn("t_us", epoch_micros("window_start"))
    keyed = sig.withColumn("p", F.explode(policies.policy_array(HOURLY_POLICIES))).select("*", "p.*").drop("p")
    fires = policies.fire_sequence(keyed, ["series_id", "scenario"])
    return fires.join(sig.select("series_id", "scenario", "window_id", "t_us", "window_start"),
                      ["series_id", "scenario", "t_us"]).drop("t_us")


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.run_backtest(features(spark, sf_dir), HOURLY_BACKTEST, HOURLY_DRIFT, HOURLY_POLICIES)
