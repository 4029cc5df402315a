"""End-to-end golden check against the published run structure.

A complete hourly series over the studied date range (16 Dec 2006 17:00 to
26 Nov 2010 21:00) with the published split, scenario rules, 168-row windows
and 60-day refit window must give the published window counts per scenario,
and the 7-day periodic policy - whose schedule does not depend on model
values - the published retrain counts, first retrain on 2009-07-08.
"""

import datetime as dt

from pyspark.sql import functions as F

from tsdrift.config import HOLIDAYS, REFERENCE_BACKTEST, REFERENCE_POLICIES, REFERENCE_SPLIT, DriftConfig
from tsdrift.operators.features import build_features
from tsdrift.plans.backtest import run_backtest
from tsdrift.plans.prepare import labelled

START = dt.datetime(2006, 12, 16, 17)
END = dt.datetime(2010, 11, 26, 21)
WINDOWS = {"baseline": 43, "seasonal_drift_winter": 9, "seasonal_drift_summer": 9,
           "holiday_drift": 2, "long_term_drift": 13}
POLICY1_RETRAINS = {"baseline": 42, "seasonal_drift_winter": 9, "seasonal_drift_summer": 9,
                    "holiday_drift": 2, "long_term_drift": 13}


def test_published_window_and_retrain_counts(spark):
    n = int((END - START).total_seconds() // 3600) + 1
    start = F.lit(START).cast("timestamp_ntz")
    series = spark.range(n).select(
        F.lit("power").alias("series_id"),
        F.timestamp_add("HOUR", F.col("id"), start).alias("ts"),
        (F.lit(1.5) + F.sin(F.col("id") * 2 * 3.141592653589793 / 24)
         + 0.3 * F.cos(F.col("id") * 2 * 3.141592653589793 / 168)).alias("value"))
    feats = labelled(build_features(series, HOLIDAYS), REFERENCE_SPLIT)
    policies = [p for p in REFERENCE_POLICIES if p.name in ("policy0", "policy1")]
    m = run_backtest(feats, REFERENCE_BACKTEST, DriftConfig(), policies)
    windows = {r.scenario: r["count"] for r in
               m.where("policy = 'policy0'").groupBy("scenario").count().collect()}
    assert windows == WINDOWS
    retrains = {r.scenario: r.n for r in
                m.where("policy = 'policy1'").groupBy("scenario").agg(F.count_if("refit").alias("n")).collect()}
    assert retrains == POLICY1_RETRAINS
    assert m.where("policy = 'policy0' AND refit").count() == 0
    first = m.where("policy = 'policy1' AND scenario = 'baseline' AND refit").agg(F.min("timestamp")).first()[0]
    assert first == dt.datetime(2009, 7, 8)
    last = m.where("policy = 'policy0' AND scenario = 'baseline'").agg(F.max("timestamp")).first()[0]
    assert last == dt.datetime(2010, 6, 30, 1)
