"""Policy pointers, many-feature models, refit candidates from running sums, staged
tuning, run-log files and the monitor's fallback."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsdrift.config import BacktestConfig, PolicySpec
from tsdrift.operators import drift, evaluate, joins, models, policies
from tsdrift.plans import backtest
from tsdrift.sources import files

HOUR = 3_600_000_000
T0 = dt.datetime(2024, 1, 1)
SIGNALS = "series_id string, t_us long, mape double, baseline_mape double, overall_drift boolean"


def attached(df, *specs):
    return df.withColumn("p", F.explode(policies.policy_array(list(specs)))).select("*", "p.*").drop("p")


def plain_fold(spec, rows):
    """Times of the triggers, window by window."""
    last, out = None, []
    for _, t, mape, base, drifted in sorted(rows, key=lambda r: (r[1], r[2], r[4])):
        ratio = None if base is None else (mape / base if base else (math.inf if mape > 0 else None))
        worse = ratio is not None and ratio > (spec.mape_threshold or 0)
        if spec.kind == "periodic":
            fire = last is None or (t - last) / (24 * HOUR) >= spec.retrain_interval_days
        elif spec.kind == "performance":
            fire = worse
        elif spec.kind == "hybrid":
            fire = (base is not None and (last is None or (t - last) / HOUR >= spec.min_retrain_interval_hours)
                    and (worse or (spec.use_drift_signals is not False and drifted)))
        else:
            fire = False
        if fire:
            last = t
            out.append(t)
    return sorted(out)


SPECS = (PolicySpec("p0", "never"), PolicySpec("p1", "periodic", retrain_interval_days=1.5), PolicySpec("p1b", "periodic", retrain_interval_days=0),
         PolicySpec("p2", "performance", mape_threshold=1.3),
         PolicySpec("p3", "hybrid", mape_threshold=1.3, min_retrain_interval_hours=30, use_drift_signals=True),
         PolicySpec("p4", "hybrid", mape_threshold=1.3, min_retrain_interval_hours=7, use_drift_signals=False))


def test_pointers_equal_a_plain_fold(spark):
    rng = random.Random(4)
    rows = []
    for s in range(6):
        for _ in range(rng.choice([1, 2, 60])):
            rows.append((f"s{s}", rng.randrange(0, 300) * HOUR, rng.choice([0.0, 1.0, 1.3, 1.4, 2.0]), [1.0, 0.0, None][s % 3], rng.random() < 0.3))
    got = policies.fire_sequence(attached(spark.createDataFrame(rows, SIGNALS), *SPECS), ["series_id"])
    assert got.count() == len(rows) * len(SPECS)
    fired = {}
    for r in got.where("fire").collect():
        fired.setdefault((r.series_id, r.policy), []).append(r.t_us)
    for spec in SPECS:
        for s in {r[0] for r in rows}:
            assert sorted(fired.get((s, spec.name), [])) == plain_fold(spec, [r for r in rows if r[0] == s]), (s, spec)


def test_one_run_of_many_windows_is_never_one_value(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("s").alias("series_id"), (F.col("id") * HOUR).alias("t_us"), F.lit(1.0).alias("mape"),
                               F.lit(1.0).alias("baseline_mape"), (F.col("id") % 5 != 0).alias("overall_drift"))
    spec = PolicySpec("p", "hybrid", mape_threshold=1.3, min_retrain_interval_hours=9, use_drift_signals=True)
    out = policies.fire_sequence(attached(df, spec), ["series_id"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = sorted(r.t_us // HOUR for r in out.where("fire").collect())
    want, last = [], None
    for t in range(n):
        if t % 5 and (last is None or t - last >= 9):
            want.append(t)
            last = t
    assert got == want


def test_zero_baseline_divides_as_floats_do(spark):
    spec = PolicySpec("p", "performance", mape_threshold=1.3)
    rows = [("s", 0, 5.0, 0.0, False), ("s", HOUR, 0.0, 0.0, False)]
    out = policies.fire_sequence(attached(spark.createDataFrame(rows, SIGNALS), spec), ["series_id"])
    assert {r.t_us: r.fire for r in out.collect()} == {0: True, HOUR: False}


def _patient():
    """Fires on the second bad window in a row, then waits for two windows."""
    def step(st, w):
        streak = F.when(w["mape"] > 1.5, st["streak"] + 1).otherwise(0)
        fire = (streak >= 2) & (st["wait"] <= 0)
        return F.struct(F.when(fire, 0).otherwise(streak).alias("streak"), F.when(fire, 2).otherwise(st["wait"] - 1).alias("wait")), fire

    return policies.OwnPolicy("patient", "streak int, wait int", {"streak": 0, "wait": 0}, step)


def test_own_policies_fold_beside_the_built_in(spark, monkeypatch):
    monkeypatch.setattr(policies, "OWN", {})
    with pytest.raises(ValueError):
        policies.policy_array([PolicySpec("p", "patient")])
    policies.register_policy(_patient())
    with pytest.raises(ValueError):
        policies.register_policy(policies.OwnPolicy("never", "x int", {"x": 0}, None))
    mapes = [2.0, 2.0, 2.0, 2.0, 1.0, 2.0, 2.0, 2.0, 2.0, 2.0]
    rows = [("s", k * HOUR, m, 1.0, False) for k, m in enumerate(mapes)]
    df = attached(spark.createDataFrame(rows, SIGNALS), PolicySpec("mine", "patient"), PolicySpec("p2", "performance", mape_threshold=1.3))
    got = {}
    for r in policies.fire_sequence(df, ["series_id"]).where("fire").collect():
        got.setdefault(r.policy, []).append(r.t_us // HOUR)
    assert sorted(got["mine"]) == [1, 6, 9] and sorted(got["p2"]) == [0, 1, 2, 3, 5, 6, 7, 8, 9]


def test_own_policy_in_the_backtest(spark, monkeypatch):
    from tsdrift.config import HOURLY_BACKTEST, HOURLY_DRIFT, HOURLY_POLICIES
    from tsdrift.plans import monitor

    monkeypatch.setattr(policies, "OWN", {})
    f = monitor.features(spark, "/root/testdata/sf0.001")
    plain = backtest.run_backtest(f, HOURLY_BACKTEST, HOURLY_DRIFT, HOURLY_POLICIES)

    def step(st, w):  # the periodic rule of policy1, as a policy of one's own
        fire = st["last"].isNull() | (w["t_us"] - st["last"] >= 48 * HOUR)
        return F.struct(F.when(fire, w["t_us"]).otherwise(st["last"]).alias("last"), (st["seen"] + 1).alias("seen")), fire

    policies.register_policy(policies.OwnPolicy("every_two_days", "last bigint, seen int", {"last": None, "seen": 0}, step))
    small = HOURLY_BACKTEST.__class__(**{**HOURLY_BACKTEST.__dict__, "chunk_windows": 3})
    both = backtest.run_backtest(f, small, HOURLY_DRIFT, (*HOURLY_POLICIES, PolicySpec("mine", "every_two_days")))
    cols = ["series_id", "scenario", "window_id", "fire", "refit", "model_time"]
    assert sorted(map(str, both.where("policy = 'mine'").select(*cols).collect())) == sorted(
        map(str, plain.where("policy = 'policy1'").select(*cols).collect()))
    assert both.where("policy <> 'mine'").count() == plain.count()


def test_stream_of_shuffled_windows_equals_batch(spark, tmp_path):
    from tsdrift.streaming import policy_stream

    rng = random.Random(9)
    start = 473_000 * HOUR  # a watermark begins at the epoch
    rows = [(f"s{k % 3}", start + (k // 3) * 5 * HOUR, rng.choice([1.0, 1.2, 1.5]), 1.0, rng.random() < 0.5) for k in range(90)]
    batch = spark.createDataFrame(rows, SIGNALS)
    specs = [s for s in SPECS if s.name != "p1b"]
    want = sorted((r.series_id, r.policy, r.t_us, r.fire) for r in policies.fire_sequence(attached(batch, *specs), ["series_id"]).collect())
    # files out of order, none further back than a day and a half
    order = sorted(range(90), key=lambda k: k + rng.randrange(-9, 10))
    late = [("s1", start, 9.0, 1.0, True)]
    parts = [[rows[k] for k in order[i:i + 15]] for i in range(0, 90, 15)]
    folder = str(tmp_path / "in")
    for part in [*parts[:5], late, parts[5]]:
        spark.createDataFrame(part, SIGNALS).coalesce(1).write.mode("append").parquet(folder)
    policy_stream.closing_window(batch, days=100).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (policy_stream.stream_policy(stream, specs, delay="40 hours").writeStream.outputMode("append").format("memory").queryName("shuffled")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted((r.series_id, r.policy, r.t_us, r.fire) for r in spark.table("shuffled").collect()) == want
    assert policy_stream.late_windows(q) == len(specs)  # the late window, once per policy


# ---------------------------------------------------------------- models
def feature_rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(50, 10, (n, 3))
    y = 7 + 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 1, n)
    # d repeats a combination of a and b, e never changes
    return [(f"s{k % 2}", T0 + dt.timedelta(hours=k // 2), *map(float, x[k]), float(x[k, 0] + 2 * x[k, 1]), 4.25, float(y[k])) for k in range(n)]


XS = ("a", "b", "c", "d", "e")
ROW = "series_id string, ts timestamp_ntz, a double, b double, c double, d double, e double, load double"


def test_many_features_equal_least_squares(spark):
    rows = feature_rows() + [("s0", T0, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {r.series_id: r for r in models.fit_grouped_multilinear(spark.createDataFrame(rows, ROW), xs=XS).collect()}
    for s in ("s0", "s1"):
        own = [r for r in rows if r[0] == s and r[2] is not None]
        x = np.array([[1, *r[2:5]] for r in own])
        want = np.linalg.lstsq(x, np.array([r[7] for r in own]), rcond=None)[0]
        assert np.allclose([got[s].intercept, *got[s].coef[:3]], want, atol=1e-8)
        assert got[s].coef[3:] == [0.0, 0.0] and got[s].n_fit == len(own)
    df = spark.createDataFrame(rows[:-1], ROW)
    pred = models.predict_multilinear(df, models.fit_grouped_multilinear(df, xs=XS), xs=XS)
    assert models.evaluate(pred).where("r2 < 0.99").count() == 0


def test_ridge_and_tiny_groups(spark):
    rows = [("s0", T0, 1.0, 0.0, 0.0, 0.0, 0.0, 5.0), ("s1", T0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("s1", T0, 3.0, 0.0, 0.0, 0.0, 0.0, 5.0)]
    got = {r.series_id: r for r in models.fit_grouped_multilinear(spark.createDataFrame(rows, ROW), xs=("a",)).collect()}
    assert (got["s0"].intercept, got["s0"].coef) == (5.0, [0.0]) and got["s1"].coef == [2.0]
    ridge = models.fit_grouped_multilinear(spark.createDataFrame(rows, ROW), xs=("a",), ridge=2.0).where("series_id = 's1'").head()
    assert ridge.coef == [1.0]


@pytest.mark.parametrize("days", [0.25, 1.0, 2.5, 6.0])
def test_candidates_from_running_sums_equal_their_rows(spark, days):
    df = spark.createDataFrame(feature_rows(), ROW).withColumn("split", F.when(F.col("ts") < "2024-01-06", "train").otherwise("test"))
    df = df.where("not (ts >= '2024-01-03' and ts < '2024-01-05')")  # a hole of whole days
    windows = df.where("hour(ts) in (0, 5, 23)").select("series_id", F.col("ts").alias("window_start"))
    windows = windows.unionByName(windows.limit(1).select("series_id", F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz").alias("window_start")))
    cfg = BacktestConfig(24, 24, days, x_col="a")
    got = {(r.series_id, r.t): r for r in backtest.candidate_multimodels(df, windows, cfg, ("a", "b")).collect()}
    sliced = joins.history_slice(windows.select("series_id", F.col("window_start").alias("t")).distinct(), df, days)
    want = {(r.series_id, r.t): r for r in models.fit_grouped_multilinear(sliced, ("series_id", "t"), ("a", "b")).collect()}
    assert {k for k, r in got.items() if r.n_fit} == want.keys() and len(got) > len(want) if days < 6 else True
    for k, r in want.items():
        assert got[k].n_fit == r.n_fit
        assert np.allclose([got[k].intercept, *got[k].coef], [r.intercept, *r.coef], rtol=1e-6, atol=1e-6), k


def test_refit_options(spark):
    from tsdrift.config import HOURLY_BACKTEST, HOURLY_DRIFT
    from tsdrift.plans import monitor

    f = monitor.features(spark, "/root/testdata/sf0.001")
    windows = monitor.windows(f)
    opened = HOURLY_BACKTEST.__class__(**{**HOURLY_BACKTEST.__dict__, "include_val": True, "closed": "left"})
    got = {(r.series_id, r.t): r.n_fit for r in backtest.candidate_models(f, windows, opened).collect()}
    hist = f.select("series_id", "ts", "load_lag_24h", "load")
    sliced = joins.history_slice(windows.select("series_id", F.col("window_start").alias("t")).distinct(), hist, opened.refit_days).where("ts < t")
    want = {(r.series_id, r.t): r["count"] for r in sliced.groupBy("series_id", "t").count().collect()}
    assert got == want
    with pytest.raises(ValueError):
        backtest.candidate_models(f, windows, HOURLY_BACKTEST.__class__(**{**HOURLY_BACKTEST.__dict__, "closed": "right"}))
    # the first window cannot refit: by default the schedule moves on, else it is tried again in the next window
    spec = (PolicySpec("p1", "periodic", retrain_interval_days=2),)
    runs = {}
    for commit in (False, True):
        cfg = HOURLY_BACKTEST.__class__(**{**HOURLY_BACKTEST.__dict__, "commit_on_success": commit})
        log = backtest.run_backtest(f, cfg, HOURLY_DRIFT, spec).where("scenario = 'baseline'")
        runs[commit] = {}
        for r in log.collect():
            runs[commit].setdefault(r.series_id, []).append((r.timestamp, r.fire, r.refit))
    assert any(fire and not refit for log in runs[True].values() for _, fire, refit in log)
    for commit, logs in runs.items():
        for log in logs.values():
            last = None
            for t, fire, refit in sorted(log):
                assert fire == (last is None or t - last >= dt.timedelta(days=2))
                last = t if (refit if commit else fire) else last


def test_gap_limit_and_bounds_of_the_training_period(spark):
    from tsdrift.operators import resample

    values = [None, 1.0, None, 3.0, None, None, 6.0, None, None]
    df = spark.createDataFrame([("s", T0 + dt.timedelta(hours=k), v) for k, v in enumerate(values)], "series_id string, ts timestamp_ntz, value double")

    def filled(**k):
        return [r.value for r in resample.interpolate_linear(df, block=2, **k).orderBy("ts").collect()]

    assert filled() == [None, 1, 2, 3, 4, 5, 6, 6, 6]
    assert filled(max_gap=1) == [None, 1, 2, 3, None, None, 6, None, None]
    assert filled(max_gap=2) == filled()
    rows = [("s", T0 + dt.timedelta(hours=k), float(v)) for k, v in enumerate([10, 10, 10, 100])] + [("late", T0 + dt.timedelta(hours=9), 50.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    capped = resample.cap_outliers(df, fit_on=F.col("ts") < T0 + dt.timedelta(hours=3))
    assert sorted(r.value for r in capped.collect()) == [10, 10, 10, 15, 50]


def test_frames_longer_than_a_block(spark):
    from tsdrift.operators import features

    rows = [("s", T0 + dt.timedelta(hours=k), float(k * k % 17)) for k in range(100)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    small, large = (sorted(map(tuple, features.lag_rolling(df, lags=(1, 30), rolls=(24,), block=b).collect()), key=lambda r: r[1]) for b in (7, 1000))
    assert len(small) == 100 and all(x == pytest.approx(y, nan_ok=True) if isinstance(x, float) else x == y for a, b in zip(small, large) for x, y in zip(a, b))


def test_first_trees_equal_a_shorter_fit(spark):
    df = spark.createDataFrame(feature_rows(200), ROW)
    long = models.fit_forecaster(df, XS, n_estimators=7, max_depth=3).stages[-1]
    short = models.fit_forecaster(df, XS, n_estimators=3, max_depth=3)
    scored = models.VectorAssembler(inputCols=list(XS), outputCol="features").transform(df)
    a = [r.prediction for r in models.first_trees(long, 3).transform(scored).collect()]
    assert a == [r.prediction for r in short.transform(df).collect()]
    assert a != [r.prediction for r in long.transform(scored).collect()]


def test_tune_reruns_agree_and_share_fits(spark, monkeypatch):
    df = spark.createDataFrame(feature_rows(160), ROW)
    space = {"n_estimators": (2, 4), "max_depth": (2,), "learning_rate": (0.1, 0.3), "subsample": (0.8,), "colsample_bytree": (0.9,)}
    fits = []
    real = models.gbt_pipeline
    monkeypatch.setattr(models, "gbt_pipeline", lambda *a, **k: fits.append(k["n_estimators"]) or real(*a, **k))
    best, table = models.tune(df, XS, space=space, n_iter=4, folds=2)
    assert fits == [4] * 4  # two rates and two folds; each scored at 2 and 4 trees
    again = models.tune(df.repartition(5), XS, space=space, n_iter=4, folds=2)
    assert table.collect() == again[1].collect() and best == again[0]
    assert isinstance(best["n_estimators"], int) and table.count() == 4
    row = min(table.collect(), key=lambda r: (r.mean_mape, r.candidate))
    assert (row.n_estimators, row.learning_rate) == (best["n_estimators"], best["learning_rate"])


# ---------------------------------------------------------------- monitor, tests, logs
def test_missing_baseline_is_the_first_window(spark):
    rows = [("a", 0, T0, 5.0, None), ("a", 1, T0 + dt.timedelta(days=1), 9.0, None), ("b", 0, T0, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, window_id long, window_start timestamp_ntz, mape double, baseline_mape double")
    got = {(r.series_id, r.window_id): r for r in drift.mape_check(drift.with_baseline(df)).collect()}
    assert [got["a", 0].mape_ratio, got["a", 1].mape_ratio, got["b", 0].mape_ratio] == [1.0, 1.8, 1.5]
    assert got["a", 1].mape_drift and not got["a", 0].mape_drift


def pairs(spark, diffs):
    return spark.createDataFrame([("k", i, 10.0 + d, 10.0) for i, d in enumerate(diffs)], "key string, window_id int, a double, b double")


def test_wilcoxon_normal_branch_by_hand(spark):
    # ranks 1.5 1.5 3 5 5 5 7 8 9.5 9.5 11 12; negatives 3, 7 and 9.5; ties of 2, 3 and 2
    r = evaluate.wilcoxon_signed_rank(pairs(spark, [1, 1, -2, 3, 3, 3, -4, 5, 6, -6, 7, 8]), ["key"]).first()
    z = (19.5 - 39) / math.sqrt(12 * 13 * 25 / 24 - (6 + 24 + 6) / 48)
    assert r.statistic == 19.5 and r.p_value == pytest.approx(math.erfc(-z / math.sqrt(2)), abs=2e-7)
    # 60 untied differences, every fourth negative: beyond the exact branch
    diffs = [-(i + 1) if i % 4 == 0 else i + 1 for i in range(60)]
    r = evaluate.wilcoxon_signed_rank(pairs(spark, diffs), ["key"]).first()
    w = sum(range(1, 61, 4))
    z = (w - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert r.statistic == w and r.p_value == pytest.approx(math.erfc(-z / math.sqrt(2)), abs=2e-7)


def test_run_log_files_as_they_lie(spark, tmp_path):
    head = "timestamp,mape,rmse,psi,ks_drifted,overall_drift\n"
    for policy, scenario, rows in (("policy0", "baseline", 2), ("policy1", "base line", 3), ("policy1", "winter", 0)):
        d = tmp_path / policy / scenario
        d.mkdir(parents=True)
        (d / f"{policy}_metrics.csv").write_text(head + "".join(f"2024-01-0{k + 1} 00:00:00,{k}.5,0.1,0.2,3,True\n" for k in range(rows)))
    (tmp_path / "policy1" / "base line" / "policy1_events.csv").write_text(
        "timestamp,event,retrain_time_seconds,trigger_reason\n2024-01-02 00:00:00,retrain,0.25,policy_trigger\n")
    (tmp_path / "policy1" / "winter" / "policy1_events.csv").write_text("timestamp,event\n")
    (tmp_path / "policy3_metrics.csv").write_text(head + "2024-01-01 00:00:00,9,9,9,9,False\n")
    (tmp_path / "policy0" / "policy0_metrics.csv").write_text(head)
    (tmp_path / "policy0" / "baseline" / "notes.csv").write_text("x\n1\n")
    (tmp_path / "policy9" / "baseline").mkdir(parents=True)
    (tmp_path / "policy9" / "baseline" / "policy9_events.csv").write_text("timestamp,event,retrain_time_seconds,trigger_reason\n2024-01-02 00:00:00,retrain,1,x\n")
    metrics, events, known = files.read_run_log_files(spark, str(tmp_path))
    assert sorted((r.policy, r.scenario, r.has_event_log) for r in known.collect()) == [
        ("policy0", "baseline", False), ("policy1", "base line", True), ("policy1", "winter", True)]
    assert sorted((r.policy, r.scenario, r.mape) for r in metrics.collect()) == [
        ("policy0", "baseline", 0.5), ("policy0", "baseline", 1.5), *[("policy1", "base line", k + 0.5) for k in range(3)]]
    assert [(r.policy, r.scenario, r.retrain_time_seconds, r.timestamp.day) for r in events.collect()] == [("policy1", "base line", 0.25, 2)]
    nothing = files.read_run_log_files(spark, str(tmp_path / "policy0"))
    assert [d.count() for d in nothing] == [0, 0, 0]
