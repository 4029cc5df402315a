"""Edge frames from FIXTURES.md: constant reference, one-row series, unknown
scenario, empty event log, determinism across shuffle partition counts."""

import datetime as dt

from pyspark.sql import functions as F

from tsdrift.operators import drift, evaluate, features, resample, scenarios
from tsdrift.sources import files

H = dt.datetime(2024, 1, 1)


def hours(spark, values, sid="s"):
    rows = [(sid, H + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def test_constant_reference_collapses(spark):
    ref = hours(spark, [5.0] * 30)
    bp = drift.quantile_breakpoints(ref).first().bp
    assert bp == [5.0]
    cur = hours(spark, [5.0, 6.0]).withColumn("window_id", F.lit(0))
    r = drift.psi(ref, cur).first()
    assert r.n_bins == 2 and r.psi > 0


def test_one_row_series(spark):
    df = hours(spark, [3.0])
    assert resample.interpolate_linear(resample.complete_grid(df)).first().value == 3.0
    f = features.lag_rolling(df).first()
    assert f.load_lag_1h is None and f.load_roll_mean_24h is None


def test_unknown_scenario_is_empty(spark):
    df = hours(spark, [1.0]).withColumn("scenario", F.lit("baseline"))
    assert scenarios.filter_scenario(df, "no_such").count() == 0
    assert scenarios.filter_scenario(df, None).count() == 1
    assert scenarios.filter_scenario(df.drop("scenario"), "x").count() == 1


def test_empty_event_log_keeps_schema(spark, tmp_path):
    m = spark.createDataFrame([("s", "policy0", "baseline", 0, H, 1.0)],
                              "series_id string, policy string, scenario string, window_id long, timestamp timestamp_ntz, mape double")
    e = spark.createDataFrame([], files.EVENT_DDL)
    files.write_run_logs(m, e, str(tmp_path / "runs"))
    m2, e2 = files.read_run_logs(spark, str(tmp_path / "runs"))
    s = evaluate.run_summary(m2, e2).first()
    assert s.num_retrains == 0 and s.total_retrain_time_seconds == 0.0
    assert set(e2.columns) >= {"event", "retrain_time_seconds", "trigger_reason"}


def test_same_result_any_partitioning(spark):
    vals = [float((i * 31) % 17) if i % 9 else None for i in range(300)]
    df = hours(spark, vals)
    outs = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        f = features.lag_rolling(resample.interpolate_linear(resample.complete_grid(df, block=64), block=64),
                                 lags=(1, 24), block=64)
        outs.append(sorted(tuple(r) for r in f.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert outs[0] == outs[1] == outs[2]


def test_exact_quantiles_match_percentile(spark):
    from tsdrift.operators.quantiles import exact_quantiles

    rows = [("a", float((i * 7919) % 1013) / 7.0) for i in range(3000)] + [("b", 2.0)] * 50 + [("c", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want[k]))


def test_many_short_series_blocked_equals_plain(spark):
    """Events keyed by user: many short, gappy series.  Small blocks force
    every halo / carry path; the result must equal one plain window per
    series."""
    from pyspark.sql import Window

    from tsdrift.sources.fixtures import user_readings

    hourly = resample.resample_mean(user_readings(spark, "/root/testdata/sf0.01"))
    filled = resample.interpolate_linear(resample.complete_grid(hourly, block=16), block=16)
    got = features.lag_rolling(filled, lags=(1, 24), rolls=(6,), block=32)
    w = Window.partitionBy("series_id").orderBy("ts")
    frame = w.rowsBetween(-5, 0)
    plain = (filled.withColumn("l1", F.lag("value", 1).over(w)).withColumn("l24", F.lag("value", 24).over(w))
                   .withColumn("m6", F.when(F.count("value").over(frame) == 6, F.avg("value").over(frame))))
    joined = got.join(plain, ["series_id", "ts"])
    assert joined.count() == plain.count() == got.count()
    bad = joined.where(
        ~F.col("load_lag_1h").eqNullSafe(F.col("l1")) | ~F.col("load_lag_24h").eqNullSafe(F.col("l24"))
        | (F.coalesce(F.abs(F.col("load_roll_mean_6h") - F.col("m6")), F.lit(0.0)) > 1e-9)
        | (F.col("load_roll_mean_6h").isNull() != F.col("m6").isNull()))
    assert bad.count() == 0
    assert got.select("series_id").distinct().count() > 100


def test_windows_match_brute_force(spark):
    n = 17
    df = hours(spark, [float(i) for i in range(n)]).withColumn("scenario", F.lit("x"))
    for size, step in ((5, 3), (4, 4), (3, 5), (6, 1)):
        got = sorted((r.window_id, int(r.value)) for r in
                     scenarios.forecast_windows(df, size, step).select("window_id", "value").collect())
        want = sorted((k, p) for k, s in enumerate(range(0, n, step)) for p in range(s, min(s + size, n)))
        assert got == want, (size, step)


def test_drift_report_lists_features_only_when_drifted(spark):
    rows = [("s", 0, True, 0.3, "critical", True, 2, ["load_lag_24h", "hour_of_day"], True, 1.4, 10.0, 14.0,
             "critical", True),
            ("s", 1, False, 0.05, "stable", False, 0, [], False, 1.0, 10.0, 10.0, "stable", False)]
    ddl = ("series_id string, window_id int, overall_drift boolean, psi double, psi_severity string, "
           "psi_drift boolean, ks_num_drifted int, drifted_features array<string>, ks_drift boolean, "
           "mape_ratio double, baseline_mape double, mape double, mape_severity string, mape_drift boolean")
    out = {r.window_id: r.report for r in drift.drift_report(spark.createDataFrame(rows, ddl)).collect()}
    assert "Features: ['load_lag_24h', 'hour_of_day']" in out[0]
    assert "Features:" not in out[1]
    assert "[PSI] Value: 0.3000, Severity: critical, Drift: True" in out[0]
    assert "[MAPE Monitor] Ratio: 1.40x baseline" in out[0]
    assert out[1].startswith("=== Drift Detection Summary ===\nOverall Drift Detected: False")


def test_rolling_exclude_current(spark):
    df = hours(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    inc = features.lag_rolling(df, lags=(), rolls=(2,), block=3)
    exc = features.lag_rolling(df, lags=(), rolls=(2,), block=3, exclude_current=True)
    order = "ts"
    assert [r.load_roll_mean_2h for r in inc.orderBy(order).collect()] == [None, 1.5, 2.5, 3.5, 4.5]
    assert [r.load_roll_mean_2h for r in exc.orderBy(order).collect()] == [None, None, 1.5, 2.5, 3.5]


def test_exact_quantiles_of_awkward_distributions(spark):
    """Log-spaced values, infinities, zeros, one hot value, neighbours one ulp
    apart: one path, no cap on rounds."""
    import math

    from tsdrift.operators.quantiles import exact_quantiles

    inf = float("inf")
    x = 1.0
    close = [x := math.nextafter(x, 2.0) for _ in range(300)]
    groups = {
        "log": [10.0 ** (k / 8 - 250) for k in range(4001)], "inf": [-inf, inf, inf, 1e308, -1e308, 0.0, -0.0, 5.0],
        "hot": [7.0] * 5000 + [float(k) for k in range(10)], "close": close, "one": [3.25], "sign": [-2.0, -1e-300, 0.0, 1e-300, 2.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("log", None)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        for p, q in zip(probs, got[g]):
            at = p * (len(vs) - 1)
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            want = lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
            assert q == want or abs(q - want) <= 1e-12 * abs(want) or (math.isnan(want) and math.isnan(q)), (g, p, q, want)


def test_exact_quantiles_of_a_million_rows(spark):
    from pyspark.sql import functions as F
    from tsdrift.operators.quantiles import exact_quantiles

    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.sqrt(F.pmod(F.col("id") * 7919, F.lit(1_000_003))).alias("v"))
    want = df.agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.999)))).head()[0]
    assert exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.999]).head().q == want


def test_series_without_reference_keep_their_rows(spark):
    from tsdrift.operators import drift

    ref = spark.createDataFrame([("a", float(i)) for i in range(50)], "series_id string, value double")
    cur = spark.createDataFrame([(s, 0, float(i)) for s in ("a", "new") for i in range(20)],
                                "series_id string, window_id int, value double")
    psi = {r.series_id: r for r in drift.psi_check(drift.psi(ref, cur)).collect()}
    assert psi["a"].psi_status == "ok" and psi["a"].psi is not None
    assert psi["new"].psi is None and psi["new"].psi_status == "no_reference" and psi["new"].psi_severity is None
    ks = {r.series_id: r for r in drift.ks_statistic(ref, cur).collect()}
    assert ks["new"].ks_statistic is None and ks["new"].p_value is None and ks["new"].ks_status == "no_reference"
    assert abs(ks["a"].ks_statistic - 0.6) < 1e-12 and ks["a"].n_cur == 20


def test_ks_of_few_distinct_values_and_a_long_sample(spark):
    """Equal values are one counted row: 24 values over 120,000 rows."""
    from pyspark.sql import functions as F
    from tsdrift.operators import drift

    n = 120_000
    ref = spark.range(n).select(F.lit("s").alias("series_id"), F.pmod("id", F.lit(24)).cast("double").alias("value"))
    cur = spark.range(n).select(F.lit("s").alias("series_id"), F.lit(1).alias("window_id"),
                                F.least(F.pmod("id", F.lit(24)), F.lit(17)).cast("double").alias("value"))
    r = drift.ks_statistic(ref, cur).head()
    assert abs(r.ks_statistic - 6 / 24) < 1e-12 and (r.n_ref, r.n_cur) == (n, n)


def test_evaluate_one_row_and_constant_groups(spark):
    from tsdrift.operators import models

    rows = [("one", 5.0, 5.0), ("off", 5.0, 4.0), ("flat", 2.0, 1.0), ("flat", 2.0, 2.0), ("ok", 1.0, 1.0), ("ok", 3.0, 2.0)]
    got = {r.series_id: r.r2 for r in models.evaluate(spark.createDataFrame(rows, "series_id string, load double, prediction double")).collect()}
    assert got == {"one": 1.0, "off": 0.0, "flat": 0.0, "ok": 0.5}


def test_nan_text_is_missing_and_extra_features_are_kept(spark):
    from pyspark.sql import functions as F
    from tsdrift.operators import features
    from tsdrift.sources import readings

    df = spark.createDataFrame([("NaN",), ("nan",), ("?",), ("1.5",), ("x",), (None,)], "t string")
    assert [r.v for r in df.select(readings.coerce_numeric("t").alias("v")).collect()] == [None, None, None, 1.5, None, None]
    wide = spark.createDataFrame([("s", 1, 2.0, 3, 4.0)], "series_id string, ts int, load double, month int, temperature double")
    x, y = features.split_features_target(wide.withColumn("scenario", F.lit("b")))
    assert x.columns == ["series_id", "ts", "month", "temperature"] and y.columns == ["series_id", "ts", "load"]


def test_missing_event_log_means_no_events_but_other_errors_do_not(spark, tmp_path):
    import pytest
    from tsdrift.sources import files

    m = spark.createDataFrame([("s", "p", "b", 1.0)], "series_id string, policy string, scenario string, mape double")
    m.write.partitionBy("policy", "scenario").parquet(str(tmp_path / "run/metrics"))
    assert files.read_run_logs(spark, str(tmp_path / "run"))[1].count() == 0
    (tmp_path / "run/events").mkdir()
    (tmp_path / "run/events/part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        files.read_run_logs(spark, str(tmp_path / "run"))[1].count()


def test_fold_parts_of_one_crowded_hour(spark):
    """All rows within one stretch of time: positions still come out exact, and
    no partition of the written positions holds them all."""
    from pyspark.sql import functions as F
    from tsdrift.operators import models

    df = spark.range(4000).select(F.timestamp_seconds(F.col("id") % 3000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("k"))
    got = models.timeseries_folds(df, 3, tiebreak=["k"])
    order = {r.k: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.ts, r.k)))}
    assert all(r.part == (0 if order[r.k] < 1000 else order[r.k] // 1000) for r in got.collect())
