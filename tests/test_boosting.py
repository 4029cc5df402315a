"""Trees grown in one task against Spark ML's, and the search that uses them."""

import numpy as np
import pandas as pd
import pytest

from tsdrift.operators import boosting, models

XS = [f"x{k}" for k in range(8)]


def made(rows, seed=3):
    g = np.random.default_rng(seed)
    x = np.column_stack([g.normal(size=rows), g.integers(0, 24, rows), g.integers(0, 2, rows), g.normal(size=rows).round(1),
                         np.zeros(rows), g.integers(-3, 4, rows), g.exponential(size=rows), np.full(rows, 7.0)])
    return x, x[:, 0] * 3 + np.sin(x[:, 1]) * 5 + x[:, 2] * x[:, 5] + g.normal(size=rows) + 20


def frame(spark, x, y):
    d = pd.DataFrame(x, columns=XS).assign(load=y, at=np.arange(len(y)))
    return spark.createDataFrame(d).repartition(1).sortWithinPartitions("at")


def folds(spark, rows=160):
    x, y = made(rows)
    d = pd.DataFrame(x, columns=XS).assign(load=y, ts=pd.date_range("2024-01-01", periods=rows, freq="h"), series_id="s")
    return spark.createDataFrame(d)


SPACE = {"n_estimators": (3, 6), "max_depth": (2, 5), "learning_rate": (0.1,), "subsample": (0.7,), "colsample_bytree": (0.8,)}


@pytest.mark.parametrize("rows, trees, depth, rate, subsample, columns", [
    (300, 8, 6, 0.1, 0.8, 0.8), (150, 4, 3, 0.3, 1.0, 1.0), (40, 6, 8, 0.05, 0.9, 0.3), (3, 3, 3, 0.1, 0.7, 0.9), (1, 2, 2, 0.1, 0.9, 0.8),
    (10_500, 2, 5, 0.1, 0.8, 0.9), (26_000, 2, 5, 0.1, 0.7, 0.8)])  # the last two: split candidates from a sample
def test_trees_of_one_task_are_spark_ml_s(spark, rows, trees, depth, rate, subsample, columns):
    x, y = made(rows)
    held, _ = made(30, seed=4)
    model = models.fit_forecaster(frame(spark, x, y), XS, n_estimators=trees, max_depth=depth, learning_rate=rate,
                                  subsample=subsample, colsample_bytree=columns)
    scored = model.stages[0].transform(frame(spark, held, np.zeros(30)))
    got = dict(boosting.staged_predictions(x, y, held, range(1, trees + 1), trees, depth, rate, subsample, str(columns), 42))
    assert sorted(got) == list(range(1, trees + 1))
    for k in (1, trees):
        want = [r.prediction for r in models.first_trees(model.stages[-1], k).transform(scored).orderBy("at").collect()]
        assert got[k].tolist() == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_sums_too_large_for_one_pass():
    assert boosting.fits_one_pass(1 << 18, 12, 10, 32) and boosting.fits_one_pass(900, 12, 30, 32)
    assert not boosting.fits_one_pass(1 << 18, 12, 20, 32)


@pytest.mark.parametrize("odd", [np.nan, np.inf])
def test_values_that_spark_ml_refuses(odd):
    for at in ("x", "y"):
        x, y = made(20)
        if at == "x":
            x[3, 0] = odd
        else:
            y[3] = odd
        with pytest.raises(ValueError, match="must not be"):
            list(boosting.staged_predictions(x, y, x, [1], 1, 2, 0.1, 0.8, "1.0", 42))


def test_search_in_tasks_equals_spark_ml_fits(spark, monkeypatch):
    df = folds(spark)
    best, table = models.tune(df, XS, space=SPACE, n_iter=4, folds=2)
    monkeypatch.setattr(boosting, "fits_one_pass", lambda *_: False)
    other, fitted = models.tune(df, XS, space=SPACE, n_iter=4, folds=2)
    assert best == other
    for a, b in zip(table.orderBy("candidate").collect(), fitted.orderBy("candidate").collect()):
        assert tuple(a)[:-1] == tuple(b)[:-1] and a.mean_mape == pytest.approx(b.mean_mape, rel=1e-9)


def test_search_needs_no_job_per_level(spark):
    def jobs(trees):
        scheduler = spark.sparkContext._jsc.sc().dagScheduler()
        before = scheduler.numTotalJobs()
        models.tune(df, XS, space={**SPACE, "n_estimators": (trees,)}, n_iter=2, folds=2)
        return scheduler.numTotalJobs() - before

    df = folds(spark)
    assert jobs(12) < jobs(3) + 20  # four fits of nine more trees


def test_search_on_more_rows_than_a_task_holds_is_distributed(spark, monkeypatch):
    real, called = models._fits_as_jobs, []
    monkeypatch.setattr(models, "_fits_as_jobs", lambda parts, target, tasks, *rest: called.append(tasks) or real(parts, target, tasks, *rest))
    monkeypatch.setattr(models, "_fits_in_tasks", None)
    space = {**SPACE, "max_depth": (2,)}
    _, table = models.tune(folds(spark), XS, space=space, n_iter=2, folds=2, rows_per_task=60)
    assert called == [3] and all(r.mean_mape > 0 for r in table.collect())
