import inspect

import pytest

from tsdrift import config
from tsdrift.operators import models
from tsdrift.plans import catalog


class Stop(Exception):
    pass


@pytest.mark.parametrize("query", [catalog.q_fit_forecaster, catalog.q_feature_importance, catalog.q_save_model])
def test_tree_queries_fit_the_library_defaults(spark, monkeypatch, query):
    called = []

    def stop(*args, **params):
        called.append(inspect.signature(models.gbt_pipeline.__wrapped__).bind(*args, **params))
        raise Stop

    stop.__wrapped__ = models.gbt_pipeline
    monkeypatch.setattr(models, "gbt_pipeline", stop)
    monkeypatch.setattr(catalog.monitor, "features", lambda *_: spark.createDataFrame([("train",)], "split string"))
    with pytest.raises(Stop):
        query(spark, "")
    called[0].apply_defaults()
    assert {k: called[0].arguments[k] for k in config.GBT_DEFAULTS} == config.GBT_DEFAULTS


def test_tune_searches_the_published_space(spark, monkeypatch):
    called = []

    def stop(*args, **params):
        called.append(stop.__signature__.bind(*args, **params))
        raise Stop

    stop.__signature__ = inspect.signature(models.tune)
    monkeypatch.setattr(models, "tune", stop)
    monkeypatch.setattr(catalog.monitor, "features", lambda *_: spark.createDataFrame([("train",)], "split string"))
    with pytest.raises(Stop):
        catalog.q_tune(spark, "")
    called[0].apply_defaults()
    got = called[0].arguments
    assert got["space"] == config.TUNING_SPACE and got["n_iter"] == config.TUNING_ITERATIONS and got["folds"] == config.TUNING_FOLDS
