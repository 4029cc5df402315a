"""Golden vectors and invariants of single operators (hand-made frames)."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsdrift.config import REFERENCE_SPLIT
from tsdrift.functions.calendar import season
from tsdrift.functions.timecols import hour_number
from tsdrift.operators import drift, features, prefix, resample, scenarios
from tsdrift.sources import readings

H = dt.datetime(2024, 1, 1)


def hours(spark, values, sid="s"):
    rows = [(sid, H + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def col(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_interpolate_golden(spark):
    df = hours(spark, [None, 1.0, None, 3.0, None])
    assert col(resample.interpolate_linear(df), "value") == [None, 1.0, 2.0, 3.0, 3.0]


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_interpolate_blocks_equal(spark, block):
    vals = [None, None, 5.0, None, None, None, 9.0, 1.0, None, None, None, None, 2.0, None]
    df = hours(spark, vals)
    assert col(resample.interpolate_linear(df, block=block), "value") == \
        col(resample.interpolate_linear(df, block=10_000), "value")


def test_complete_grid_fills_gaps(spark):
    df = hours(spark, [1.0, 2.0, 3.0, 4.0]).where("value != 2.0")
    g = resample.complete_grid(df, block=2)
    assert col(g, "value") == [1.0, None, 3.0, 4.0]


def test_assign_bins_golden(spark):
    bp = spark.createDataFrame([("s", [1.0, 2.0, 3.0])], "series_id string, bp array<double>")
    v = spark.createDataFrame([("s", x) for x in (1.0, 2.0, 2.5, 3.0, 4.0)], "series_id string, value double")
    assert col(drift.assign_bins(v, bp), "bin", "value") == [0, 1, 2, 2, 3]


def test_psi_identity_and_overflow(spark):
    ref = hours(spark, [float(i % 17) for i in range(200)])
    cur = ref.withColumn("window_id", F.lit(0))
    assert abs(drift.psi(ref, cur).first()["psi"]) < 1e-12
    high = hours(spark, [100.0] * 10).withColumn("window_id", F.lit(0))
    assert drift.psi(ref, high).first()["psi"] > 1.0  # overflow bin counted, no failure


def test_ks_identity_and_symmetry(spark):
    a = hours(spark, [float(i % 13) for i in range(120)])
    b = hours(spark, [float((i * 7) % 29) for i in range(90)])
    same = drift.ks_statistic(a, a.withColumn("window_id", F.lit(0))).first()
    assert same["ks_statistic"] == 0 and same["p_value"] == 1.0
    d1 = drift.ks_statistic(a, b.withColumn("window_id", F.lit(0))).first()["ks_statistic"]
    d2 = drift.ks_statistic(b, a.withColumn("window_id", F.lit(0))).first()["ks_statistic"]
    assert abs(d1 - d2) < 1e-12 and 0 <= d1 <= 1


def test_ks_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, 150).astype(float)
    y = rng.integers(3, 25, 40).astype(float)
    grid = np.union1d(x, y)
    d = max(abs((x <= g).mean() - (y <= g).mean()) for g in grid)
    got = drift.ks_statistic(hours(spark, [float(v) for v in x]),
                             hours(spark, [float(v) for v in y]).withColumn("window_id", F.lit(0)),
                             buckets=8).first()["ks_statistic"]
    assert abs(got - d) < 1e-12


def test_psi_check_and_mape_check(spark):
    p = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.2499, 0.25)], "psi double")
    out = drift.psi_check(p, 0.25).orderBy("psi").collect()
    assert [r.psi_severity for r in out] == ["stable", "warning", "warning", "critical"]
    assert [r.psi_drift for r in out] == [False, False, False, True]
    m = spark.createDataFrame([(1.14, 1.0), (1.15, 1.0), (1.30, 1.0)], "mape double, baseline_mape double")
    sev = [r.mape_severity for r in drift.mape_check(m).orderBy("mape").collect()]
    assert sev == ["stable", "warning", "critical"]


def test_calendar_golden(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6),)], "ts timestamp_ntz")
    r = features.calendar_features(df).first()
    assert (r.day_of_week, r.is_weekend) == (5, 1)
    m = spark.createDataFrame([(x,) for x in (12, 1, 3, 6, 9)], "m int")
    assert [r[0] for r in m.select(season("m")).collect()] == [0, 0, 1, 2, 3]


def test_parse_timestamp(spark):
    df = spark.createDataFrame([("16/12/2006", "17:24:00")], "d string, t string")
    assert df.select(readings.parse_timestamp("d", "t")).first()[0] == dt.datetime(2006, 12, 16, 17, 24)
    bad = spark.createDataFrame([("31/02/2007", "00:00:00")], "d string, t string")
    with pytest.raises(Exception):
        bad.select(readings.parse_timestamp("d", "t")).collect()
    assert bad.select(readings.parse_timestamp("d", "t", on_error="null")).first()[0] is None


def test_scenario_inclusive_end(spark):
    df = spark.createDataFrame([(dt.datetime(2009, 12, 31, 0),), (dt.datetime(2009, 12, 31, 1),)],
                               "ts timestamp_ntz")
    out = scenarios.label_scenarios(scenarios.chronological_split(df, REFERENCE_SPLIT), REFERENCE_SPLIT)
    assert col(out, "scenario") == ["holiday_drift", "baseline"]


def test_forecast_windows(spark):
    df = hours(spark, [1.0] * 265).withColumn("scenario", F.lit("x"))
    w = scenarios.forecast_windows(df, 168, 168).groupBy("window_id").count().orderBy("window_id")
    assert [r["count"] for r in w.collect()] == [168, 97]
    small = hours(spark, [1.0] * 10).withColumn("scenario", F.lit("x"))
    hop = scenarios.forecast_windows(small, 4, 2).groupBy("window_id").count().orderBy("window_id")
    assert [r["count"] for r in hop.collect()] == [4, 4, 4, 4, 2]
    gap = scenarios.forecast_windows(small, 2, 4).groupBy("window_id").count().orderBy("window_id")
    assert [r["count"] for r in gap.collect()] == [2, 2, 2]


@pytest.mark.parametrize("block", [5, 30])
def test_halo_equals_plain_window(spark, block):
    vals = [float((i * 37) % 11) for i in range(60)]
    df = hours(spark, vals)
    got = features.lag_rolling(df, lags=(1, 3), rolls=(4,), block=block).orderBy("ts").collect()
    w = Window.partitionBy("series_id").orderBy("ts")
    full = (df.withColumn("l1", F.lag("value", 1).over(w)).withColumn("l3", F.lag("value", 3).over(w))
              .withColumn("m", F.when(F.count("value").over(w.rowsBetween(-3, 0)) == 4,
                                      F.avg("value").over(w.rowsBetween(-3, 0))))
              .orderBy("ts").collect())
    for g, f in zip(got, full):
        assert g.load_lag_1h == f.l1 and g.load_lag_3h == f.l3
        assert (g.load_roll_mean_4h is None and f.m is None) or abs(g.load_roll_mean_4h - f.m) < 1e-12


def test_positions_match_row_number(spark):
    df = hours(spark, [1.0] * 50)
    got = prefix.positions(df, ["series_id"], ["ts"], F.floor(hour_number("ts") / 7), "pos")
    assert col(got, "pos") == list(range(50))


def test_holiday_flag_table_and_list(spark):
    df = spark.createDataFrame([(dt.datetime(2008, 7, 14, 5),), (dt.datetime(2008, 7, 15, 5),)], "ts timestamp_ntz")
    assert col(features.holiday_flag(df), "is_holiday") == [1, 0]
    tbl = spark.createDataFrame([("2008-07-14",)], "d string")
    assert col(features.holiday_flag(df, tbl), "is_holiday") == [1, 0]


def test_null_audit_and_require_complete(spark):
    df = hours(spark, [1.0, None])
    audit = {r.column_name: r.null_count for r in resample.null_audit(df).collect()}
    assert audit["value"] == 1
    with pytest.raises(ValueError):
        resample.require_complete(df)
