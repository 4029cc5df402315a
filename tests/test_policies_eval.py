"""Policy folds, backtest invariants and comparison statistics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsdrift.config import PolicySpec
from tsdrift.operators import evaluate, joins, policies

T0 = dt.datetime(2024, 1, 1)


def fires(spark, spec, hours_list, cond=None, mape=None, baseline=1.0):
    cond = cond or [True] * len(hours_list)
    mape = mape or [1.0] * len(hours_list)
    rows = [("s", int(h * 3_600_000_000), m, baseline, c) for h, m, c in zip(hours_list, mape, cond)]
    df = spark.createDataFrame(rows, "series_id string, t_us long, mape double, baseline_mape double, overall_drift boolean")
    df = df.withColumn("p", F.explode(policies.policy_array([spec]))).select("*", "p.*").drop("p")
    out = policies.fire_sequence(df, ["series_id"]).orderBy("t_us").collect()
    return [r.t_us // 3_600_000_000 for r in out if r.fire]


def test_hybrid_guard(spark):
    spec = PolicySpec("p3", "hybrid", mape_threshold=1.3, min_retrain_interval_hours=168, use_drift_signals=True)
    assert fires(spark, spec, [0, 168, 200, 336, 400], cond=[True, True, True, False, True]) == [0, 168, 400]


def test_periodic(spark):
    spec = PolicySpec("p1", "periodic", retrain_interval_days=7)
    assert fires(spark, spec, [24 * d for d in range(16)]) == [0, 168, 336]


def test_performance_strict(spark):
    spec = PolicySpec("p2", "performance", mape_threshold=1.30)
    assert fires(spark, spec, [0, 1], cond=[False, False], mape=[1.30, 1.31]) == [1]


def test_never_and_unknown(spark):
    assert fires(spark, PolicySpec("p0", "never"), [0, 1, 2]) == []
    with pytest.raises(ValueError):
        policies.policy_array([PolicySpec("bad", "sometimes")])


def pairs(spark, diffs):
    rows = [("k", i, 10.0 + d, 10.0) for i, d in enumerate(diffs)]
    return spark.createDataFrame(rows, "key string, window_id int, a double, b double")


@pytest.mark.parametrize("diffs,expected", [
    ([-1, -2, -3, -4, -5, -6, -7, -8], 0.0078),
    ([1, -2, -3, -4, -5, -6, -7, -8], 0.0156),
    ([-(i + 1) for i in range(12)], 0.0005),
])
def test_wilcoxon_exact_golden(spark, diffs, expected):
    r = evaluate.wilcoxon_signed_rank(pairs(spark, diffs), ["key"]).first()
    assert round(r.p_value, 4) == expected


def test_wilcoxon_all_zero(spark):
    r = evaluate.wilcoxon_signed_rank(pairs(spark, [0, 0, 0]), ["key"]).first()
    assert (r.p_value, r.statistic) == (1.0, 0.0)


def test_wilcoxon_normal_approx_ties(spark):
    scipy = pytest.importorskip("scipy.stats")
    diffs = [1, 1, -2, 3, 3, 3, -4, 5, 6, -6, 7, 8]
    r = evaluate.wilcoxon_signed_rank(pairs(spark, diffs), ["key"]).first()
    ref = scipy.wilcoxon([10.0 + d for d in diffs], [10.0] * len(diffs), method="approx")
    assert abs(r.p_value - ref.pvalue) < 1e-6


def test_cohens_d(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 3.0, 2.0)], "key string, a double, b double")
    assert evaluate.cohens_d(df, ["key"]).first().cohens_d == 0.0


def test_pareto_ties_broken(spark):
    s = spark.createDataFrame([("x", "sc", "p0", 0, 5.0), ("x", "sc", "p1", 0, 4.0), ("x", "sc", "p2", 3, 4.5),
                               ("x", "sc", "p3", 5, 3.0)],
                              "series_id string, scenario string, policy string, num_retrains long, mean_mape double")
    got = [r.policy for r in evaluate.pareto_frontier(s).orderBy("num_retrains").collect()]
    assert got == ["p1", "p3"]


def test_asof_forward(spark):
    m = spark.createDataFrame([("k", T0, 1.0), ("k", T0 + dt.timedelta(hours=2), 2.0)],
                              "key string, timestamp timestamp_ntz, mape double")
    e = spark.createDataFrame([("k", T0 + dt.timedelta(hours=1)), ("k", T0 + dt.timedelta(hours=3)), ("k", T0)],
                              "key string, timestamp timestamp_ntz")
    got = [r.mape for r in joins.asof_forward(e, m, ["key"]).orderBy("timestamp").collect()]
    assert got == [1.0, 2.0, 2.0]


def test_bootstrap_deterministic(spark):
    v = spark.createDataFrame([("k", i, float(i)) for i in range(6)], "key string, window_id long, mape double")
    a = evaluate.bootstrap_ci(v, ["key"], reps=200).first()
    b = evaluate.bootstrap_ci(v.repartition(3), ["key"], reps=200).first()
    assert a == b and a.ci_lower <= a.mean <= a.ci_upper


def test_history_slice_inclusive(spark):
    c = spark.createDataFrame([("s", T0 + dt.timedelta(days=2))], "series_id string, t timestamp_ntz")
    h = spark.createDataFrame([("s", T0 + dt.timedelta(hours=i)) for i in range(0, 80)], "series_id string, ts timestamp_ntz")
    got = joins.history_slice(c, h, 1.0).count()
    assert got == 25  # hours 24..48 inclusive
