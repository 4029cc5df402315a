"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB
oracle statement for each name that has one.  Names are the lower-case
operator names of the design survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsdrift.config import FEATURE_ORDER, HOURLY_BACKTEST, HOURLY_DRIFT
from tsdrift.operators import drift, features, resample, scenarios
from tsdrift.plans import oracle as O
from tsdrift.plans import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def snap(col, places: int = O.R):
    """Compared doubles are first snapped to a 2^-20 grid, then rounded to
    ``places`` decimals; the two engines then agree bit for bit even where a
    value sits on a decimal rounding tie and their sums differ by one ulp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.round(c * F.lit(O.GRID_SCALE)) / F.lit(O.GRID_SCALE), places)


def rounded(df: DataFrame, places: int = O.R) -> DataFrame:
    """Snap every double column (compared values are snapped on both sides)."""
    return df.select(*[snap(f.name, places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def psi_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI and severity of each scoring window of each event series against
    its training period (the flagship query)."""
    from tsdrift.plans import monitor

    f = monitor.features(spark, sf_dir)
    ref = f.where(F.col("split") == "train").select("series_id", F.col("load").alias("value"))
    cur = monitor.windows(f).select("series_id", "scenario", "window_id", F.col("load").alias("value"))
    p = drift.psi(ref, cur, window_keys=("scenario", "window_id"), bins=HOURLY_DRIFT.bins,
                  epsilon=HOURLY_DRIFT.epsilon, written=True)
    p = drift.psi_check(p, HOURLY_DRIFT.psi_threshold)
    return rounded(p.select("series_id", "scenario", "window_id", "psi", F.col("n_bins").cast("bigint"),
                            "psi_severity", "psi_drift"))


def test_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = prepare.hourly_features(spark, sf_dir)
    return scenarios.forecast_windows(f.where(F.col("split") == "test"),
                                      HOURLY_BACKTEST.window_size, HOURLY_BACKTEST.step)


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.hourly_features(spark, sf_dir).where(F.col("split") == "train")


def rd(col: str, alias: str | None = None) -> str:
    return f"{O.snap(col)} AS {alias or col.split('.')[-1]}"


# ---------------------------------------------------------------- RSM / AGG
@register("resample_mean", O.with_(O.HOURLY) + f"SELECT series_id, ts, {rd('value')} FROM hourly")
def q_resample_mean(spark, sf):
    return rounded(prepare.hourly_series(spark, sf))


@register("complete_grid", O.with_(O.HOURLY, O.GRID) + f"SELECT series_id, ts, {rd('value')} FROM grid")
def q_complete_grid(spark, sf):
    return rounded(prepare.hourly_grid(spark, sf))


@register("interpolate_linear", O.with_(O.HOURLY, O.GRID, O.FILLED) + f"SELECT series_id, ts, {rd('value')} FROM filled")
def q_interpolate_linear(spark, sf):
    return rounded(prepare.hourly_filled(spark, sf))


@register("cap_outliers", O.with_(O.HOURLY, O.GRID, O.FILLED, O.REPAIRED)
          + f"SELECT series_id, ts, {rd('value')} FROM repaired")
def q_cap_outliers(spark, sf):
    return rounded(prepare.hourly_repaired(spark, sf))


@register("repair_audit", O.with_(O.HOURLY, O.GRID, O.FILLED) + f"""
SELECT g.series_id, {rd('b.ub', 'upper_bound')},
  count_if(g.value IS NULL) AS missing_before, count_if(f.value IS NULL) AS missing_after,
  count_if(f.value > b.ub) AS capped_count
FROM grid g JOIN filled f USING (series_id, ts)
JOIN (SELECT series_id, quantile_cont(value, 0.99) * 1.5 AS ub FROM filled GROUP BY 1) b USING (series_id)
GROUP BY g.series_id, b.ub""")
def q_repair_audit(spark, sf):
    return rounded(resample.repair_audit(prepare.hourly_grid(spark, sf)))


@register("null_audit", O.with_(*O.PREP) + "SELECT column_name, CAST(null_count AS BIGINT) AS null_count FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count FROM repaired"
                               for c in ("series_id", "ts", "value")) + ")")
def q_null_audit(spark, sf):
    return resample.null_audit(prepare.hourly_repaired(spark, sf))


@register("value_counts", O.with_(*O.PREP)
          + "SELECT split, scenario, count(*) AS n FROM features GROUP BY ALL")
def q_value_counts(spark, sf):
    f = prepare.hourly_features(spark, sf)
    return resample.value_counts(f, "scenario", by=["split"])


# ---------------------------------------------------------------- features
_LAG_SQL = O.with_(*O.PREP) + "SELECT series_id, ts, " + ", ".join(
    rd(c) for c in ("load", "load_lag_1h", "load_lag_24h", "load_lag_168h")) + " FROM feat0"


@register("lag_features", _LAG_SQL)
def q_lag_features(spark, sf):
    d = features.lag_rolling(prepare.hourly_repaired(spark, sf), rolls=())
    return rounded(d.withColumnRenamed("value", "load"))


@register("rolling_mean", O.with_(*O.PREP) + f"SELECT series_id, ts, {rd('load_roll_mean_24h')} FROM feat0")
def q_rolling_mean(spark, sf):
    d = features.lag_rolling(prepare.hourly_repaired(spark, sf), lags=())
    return rounded(d.select("series_id", "ts", "load_roll_mean_24h"))


@register("rolling_std", O.with_(*O.PREP) + f"SELECT series_id, ts, {rd('load_roll_std_24h')} FROM feat0")
def q_rolling_std(spark, sf):
    d = features.lag_rolling(prepare.hourly_repaired(spark, sf), lags=())
    return rounded(d.select("series_id", "ts", "load_roll_std_24h"))


@register("calendar_features", O.with_(O.HOURLY) + f"SELECT series_id, ts, {O.CALENDAR_COLS} FROM hourly")
def q_calendar_features(spark, sf):
    d = features.calendar_features(prepare.hourly_series(spark, sf))
    return d.drop("value")


@register("feature_table", O.with_(*O.PREP) + "SELECT series_id, ts, " + ", ".join(
    rd(c) if c.startswith("load") else c for c in ("load", *O.FEATURE_COLS)) + ", split, scenario FROM features")
def q_feature_table(spark, sf):
    return rounded(prepare.hourly_features(spark, sf))


# ---------------------------------------------------------------- windows / drift
@register("forecast_windows", O.with_(*O.PREP, O.windows_cte())
          + f"SELECT series_id, scenario, ts, pos, window_id, window_start, {rd('load')} FROM win")
def q_forecast_windows(spark, sf):
    return rounded(test_windows(spark, sf).select("series_id", "scenario", "ts", "pos", "window_id",
                                                  "window_start", "load"))


_PSI_SQL = O.with_(*O.PREP, O.windows_cte(), *O.psi_ctes()) + f"""
SELECT series_id, scenario, window_id, {rd('psi')}, n_bins,
  {O.psi_severity_sql()} AS psi_severity, {O.psi_drift_sql()} AS psi_drift
FROM psi_t"""


register("psi", _PSI_SQL)(psi_windows)


# ---------------------------------------------------------------- KS / monitor
from tsdrift.config import DAILY_SPLIT, HOURLY_POLICIES, REFERENCE_BACKTEST, REFERENCE_POLICIES, DriftConfig  # noqa: E402
from tsdrift.plans import monitor  # noqa: E402

_DRIFT_CTES = (*O.PREP, O.windows_cte(), *O.psi_ctes(), *O.ks_ctes())
_BT_CTES = (*_DRIFT_CTES, *O.model_ctes(), *O.backtest_ctes(HOURLY_POLICIES))


def _ks_per_feature(spark, sf):
    f = monitor.features(spark, sf)
    per, _ = drift.ks_multi(f.where(F.col("split") == "train"), monitor.windows(f), HOURLY_DRIFT.features,
                            window_keys=monitor.WKEYS, drift_count=HOURLY_DRIFT.ks_drift_count,
                            alpha=HOURLY_DRIFT.ks_alpha)
    return per


@register("ks_statistic", O.with_(*_DRIFT_CTES) + f"""
SELECT series_id, feature, scenario, window_id, {rd('ks_statistic')}, n_ref, n_cur FROM ks_t""")
def q_ks_statistic(spark, sf):
    return rounded(_ks_per_feature(spark, sf).select("series_id", "feature", "scenario", "window_id",
                                                     "ks_statistic", "n_ref", "n_cur"))


@register("ks_pvalue", O.with_(*_DRIFT_CTES) + f"""
SELECT series_id, feature, scenario, window_id, {rd('p_value')}, p_value < {HOURLY_DRIFT.ks_alpha} AS is_drift FROM ks_p""")
def q_ks_pvalue(spark, sf):
    return rounded(_ks_per_feature(spark, sf).select("series_id", "feature", "scenario", "window_id",
                                                     "p_value", "is_drift"))


@register("ks_multi", O.with_(*_DRIFT_CTES) + f"""
SELECT series_id, scenario, window_id, coalesce(drifted_features, '') AS drifted_features, ks_num_drifted,
  ks_num_drifted >= {HOURLY_DRIFT.ks_drift_count} AS ks_drift FROM ks_v""")
def q_ks_multi(spark, sf):
    f = monitor.features(spark, sf)
    _, summ = drift.ks_multi(f.where(F.col("split") == "train"), monitor.windows(f), HOURLY_DRIFT.features,
                             window_keys=monitor.WKEYS, drift_count=HOURLY_DRIFT.ks_drift_count,
                             alpha=HOURLY_DRIFT.ks_alpha)
    return summ.select("series_id", "scenario", "window_id",
                       F.array_join("drifted_features", ",").alias("drifted_features"),
                       F.col("ks_num_drifted").cast("int"), "ks_drift")


@register("quantile_breakpoints", O.with_(*O.PREP, "trainf AS (SELECT * FROM features WHERE split = 'train')",
                                          O.breakpoints_cte("bp", "trainf", "load"))
          + f"SELECT series_id, CAST(i AS INTEGER) AS i, {O.snap('bp[i + 1]')} AS breakpoint "
            "FROM (SELECT series_id, bp, unnest(range(0, len(bp))) AS i FROM bp)")
def q_quantile_breakpoints(spark, sf):
    bp = drift.quantile_breakpoints(train_rows(spark, sf), "load")
    return rounded(bp.select("series_id", F.posexplode("bp").alias("i", "breakpoint")))


@register("assign_bins", O.with_(*O.PREP, O.windows_cte(), *O.psi_ctes()[:2]) + """
SELECT w.series_id, w.scenario, w.ts, CAST(len(list_filter(b.bp, lambda x: x < w.load)) AS INTEGER) AS bin
FROM win w JOIN bp b USING (series_id)""")
def q_assign_bins(spark, sf):
    f = monitor.features(spark, sf)
    bp = drift.quantile_breakpoints(f.where(F.col("split") == "train"), "load")
    return drift.assign_bins(monitor.windows(f), bp, "load").select("series_id", "scenario", "ts", "bin")


_PRICE_CUT = "2000-01-01"


@register("psi_check", O.with_(
    f"pref AS (SELECT l_returnflag AS series_id, l_extendedprice::DOUBLE AS value FROM lineitem WHERE l_shipdate < DATE '{_PRICE_CUT}')",
    f"""pcur AS (SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate)::TIMESTAMP AS month, l_extendedprice::DOUBLE AS value
        FROM lineitem WHERE l_shipdate >= DATE '{_PRICE_CUT}')""",
    *O.psi_ctes("value", cur="pcur", wkeys=("month",), ref_src="pref", ref_where="TRUE")) + f"""
SELECT series_id, month, {rd('psi')}, {O.psi_severity_sql()} AS psi_severity, {O.psi_drift_sql()} AS psi_drift FROM psi_t""")
def q_psi_check(spark, sf):
    """Prices of each return flag, month by month, against the years before."""
    from tsdrift.sources.fixtures import lineitem_prices

    d = lineitem_prices(spark, sf)
    cur = d.where(F.col("ts") >= _PRICE_CUT).withColumn("month", F.make_timestamp_ntz(F.year("ts"), F.month("ts"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    p = drift.psi(d.where(F.col("ts") < _PRICE_CUT), cur, window_keys=("month",))
    return rounded(drift.psi_check(p).select("series_id", "month", "psi", "psi_severity", "psi_drift"))


_MON_SQL = O.with_(*_BT_CTES) + f"""
SELECT w.series_id, w.scenario, w.window_id, {rd('ps.psi', 'psi')}, {O.psi_severity_sql('ps.psi')} AS psi_severity,
  {O.psi_drift_sql('ps.psi')} AS psi_drift,
  coalesce(kv.ks_num_drifted, 0) AS ks_num_drifted, coalesce(kv.ks_num_drifted, 0) >= {HOURLY_DRIFT.ks_drift_count} AS ks_drift,
  {rd('pr.mape', 'mape')}, {rd('b.baseline_mape', 'baseline_mape')},
  {rd('pr.mape / b.baseline_mape', 'mape_ratio')},
  CASE WHEN pr.mape / b.baseline_mape >= {HOURLY_DRIFT.mape_beta} THEN 'critical'
       WHEN pr.mape / b.baseline_mape >= {HOURLY_DRIFT.mape_alpha} THEN 'warning' ELSE 'stable' END AS mape_severity,
  pr.mape / b.baseline_mape >= {HOURLY_DRIFT.mape_beta} AS mape_drift,
  ({O.psi_drift_sql('ps.psi')} OR coalesce(kv.ks_num_drifted, 0) >= {HOURLY_DRIFT.ks_drift_count}
   OR pr.mape / b.baseline_mape >= {HOURLY_DRIFT.mape_beta}) AS overall_drift
FROM (SELECT DISTINCT series_id, scenario, window_id FROM win) w
JOIN psi_t ps USING (series_id, scenario, window_id)
LEFT JOIN ks_v kv USING (series_id, scenario, window_id)
JOIN pairs pr ON pr.series_id = w.series_id AND pr.scenario = w.scenario AND pr.window_id = w.window_id AND pr.mt IS NULL
JOIN base b ON b.series_id = w.series_id"""


@register("drift_monitor", _MON_SQL)
def q_drift_monitor(spark, sf):
    m = monitor.static_monitor(monitor.features(spark, sf))
    return rounded(m.select("series_id", "scenario", "window_id", "psi", "psi_severity", "psi_drift",
                            F.coalesce(F.col("ks_num_drifted"), F.lit(0)).cast("int").alias("ks_num_drifted"),
                            F.coalesce(F.col("ks_drift"), F.lit(False)).alias("ks_drift"),
                            "mape", "baseline_mape", "mape_ratio", "mape_severity", "mape_drift",
                            "overall_drift"))


@register("mape_check", O.with_(*_BT_CTES) + f"""
SELECT pr.series_id, pr.scenario, pr.window_id, {rd('pr.mape', 'mape')}, {rd('pr.mape / b.baseline_mape', 'mape_ratio')},
  pr.mape / b.baseline_mape >= {HOURLY_DRIFT.mape_alpha} AS mape_warning,
  pr.mape / b.baseline_mape >= {HOURLY_DRIFT.mape_beta} AS mape_drift
FROM pairs pr JOIN base b USING (series_id) WHERE pr.mt IS NULL""")
def q_mape_check(spark, sf):
    s = drift.mape_check(monitor.static_scores(monitor.features(spark, sf)),
                         alpha=HOURLY_DRIFT.mape_alpha, beta=HOURLY_DRIFT.mape_beta)
    return rounded(s.select("series_id", "scenario", "window_id", "mape", "mape_ratio", "mape_warning", "mape_drift"))


# ---------------------------------------------------------------- models
from tsdrift.operators import joins, models  # noqa: E402
from tsdrift.plans import backtest as BT  # noqa: E402


@register("fit_grouped_linear", O.with_(*_BT_CTES) + f"SELECT series_id, {rd('a')}, {rd('b')}, n_fit FROM m0")
def q_fit_grouped_linear(spark, sf):
    m0 = models.fit_grouped_linear(train_rows(spark, sf), x=HOURLY_BACKTEST.x_col, y=HOURLY_BACKTEST.y_col)
    return rounded(m0)


_VAL_PRED = "(SELECT f.*, m.a + m.b * f.load_lag_24h AS prediction FROM features f JOIN m0 m USING (series_id) WHERE f.split = 'val')"


def _val_predictions(spark, sf):
    f = monitor.features(spark, sf)
    m0 = models.fit_grouped_linear(f.where(F.col("split") == "train"), x=HOURLY_BACKTEST.x_col, y=HOURLY_BACKTEST.y_col)
    return models.predict_linear(f.where(F.col("split") == "val"), m0, x=HOURLY_BACKTEST.x_col)


_EVAL_SQL = O.with_(*_BT_CTES) + f"""
SELECT series_id, {rd('avg(abs((load - prediction) / (load + 1e-08))) * 100', 'mape')},
  {rd('sqrt(avg((load - prediction) * (load - prediction)))', 'rmse')},
  {rd('1.0 - sum((load - prediction) * (load - prediction)) / (var_pop(load) * count(load))', 'r2')},
  count(*) AS n
FROM {_VAL_PRED} GROUP BY 1"""


@register("evaluate", _EVAL_SQL)
def q_evaluate(spark, sf):
    return rounded(models.evaluate(_val_predictions(spark, sf)))


@register("predict", O.with_(*_BT_CTES) + f"SELECT series_id, ts, {rd('prediction')} FROM {_VAL_PRED}")
def q_predict(spark, sf):
    return rounded(_val_predictions(spark, sf).select("series_id", "ts", "prediction"))


@register("residuals", O.with_(*_BT_CTES) + f"SELECT series_id, ts, {rd('load - prediction', 'residual')} FROM {_VAL_PRED}")
def q_residuals(spark, sf):
    return rounded(models.residuals(_val_predictions(spark, sf)).select("series_id", "ts", "residual"))


@register("quality_gate", O.with_(*_BT_CTES) + f"""
SELECT series_id, CASE WHEN mape < 5.0 THEN 'PASS' ELSE 'FAIL' END AS mape_status,
  CASE WHEN r2 > 0.9 THEN 'PASS' ELSE 'WARN' END AS r2_status
FROM (SELECT series_id, avg(abs((load - prediction) / (load + 1e-08))) * 100 AS mape,
        1.0 - sum((load - prediction) * (load - prediction)) / (var_pop(load) * count(load)) AS r2
      FROM {_VAL_PRED} GROUP BY 1)""")
def q_quality_gate(spark, sf):
    g = models.quality_gate(models.evaluate(_val_predictions(spark, sf)))
    return g.select("series_id", "mape_status", "r2_status")


@register("history_slice", O.with_(*_BT_CTES) + f"""
SELECT c.series_id, c.t, h.ts, {rd('h.load', 'load')}
FROM cand c JOIN features h ON h.series_id = c.series_id AND h.split IN ('train', 'test')
  AND h.ts >= c.t - to_microseconds({int(HOURLY_BACKTEST.refit_days * 86_400_000_000)}) AND h.ts <= c.t""")
def q_history_slice(spark, sf):
    f = monitor.features(spark, sf)
    cands = monitor.windows(f).select("series_id", F.col("window_start").alias("t")).distinct()
    hist = joins.train_plus_test_history(f.where(F.col("split") == "train"), f.where(F.col("split") == "test"))
    return rounded(joins.history_slice(cands, hist, HOURLY_BACKTEST.refit_days).select("series_id", "t", "ts", "load"))


@register("train_plus_test_history", O.with_(*O.PREP)
          + f"SELECT series_id, ts, split, {rd('load')} FROM features WHERE split IN ('train', 'test')")
def q_train_plus_test_history(spark, sf):
    f = monitor.features(spark, sf)
    u = joins.train_plus_test_history(f.where(F.col("split") == "train"), f.where(F.col("split") == "test"))
    return rounded(u.select("series_id", "ts", "split", "load"))


@register("candidate_models", O.with_(*_BT_CTES) + f"SELECT series_id, t, {rd('a')}, {rd('b')}, n_fit FROM cfit")
def q_candidate_models(spark, sf):
    f = monitor.features(spark, sf)
    c = BT.candidate_models(f, monitor.windows(f), HOURLY_BACKTEST).where(F.col("n_fit") > 0)
    return rounded(c.select("series_id", "t", "a", "b", F.col("n_fit").cast("bigint")))


_XS = FEATURE_ORDER
_COEFS = ", ".join(rd(f"coef[{i + 1}]", f"b_{c}") for i, c in enumerate(_XS))


def _with_coefs(fit, *keys):
    return rounded(fit.select(*keys, "intercept", *[F.get("coef", F.lit(i)).alias(f"b_{c}") for i, c in enumerate(_XS)], "n_fit"))


@register("fit_grouped_multilinear", O.with_(*O.PREP, *O.multilinear_ctes("ml", "(SELECT * FROM features WHERE split = 'train')", _XS))
          + f"SELECT series_id, {rd('intercept')}, {_COEFS}, n_fit FROM ml")
def q_fit_grouped_multilinear(spark, sf):
    """MDL-8 on all 12 features."""
    return _with_coefs(models.fit_grouped_multilinear(train_rows(spark, sf), xs=_XS), "series_id")


_ML_PRED = """(SELECT f.*, m.intercept + list_sum(list_transform(range(1, 13), lambda i: m.coef[i] * [%s][i])) AS prediction
  FROM features f JOIN ml m USING (series_id) WHERE f.split = 'val')""" % ", ".join(f"CAST(f.{c} AS DOUBLE)" for c in _XS)


@register("evaluate_multilinear",
          O.with_(*O.PREP, *O.multilinear_ctes("ml", "(SELECT * FROM features WHERE split = 'train')", _XS)) + f"""
SELECT series_id, {rd('avg(abs((load - prediction) / (load + 1e-08))) * 100', 'mape')},
  {rd('sqrt(avg((load - prediction) * (load - prediction)))', 'rmse')}, count(*) AS n FROM {_ML_PRED} GROUP BY 1""")
def q_evaluate_multilinear(spark, sf):
    """MDL-2/3 of the 12-feature model on the validation split."""
    f = monitor.features(spark, sf)
    m = models.fit_grouped_multilinear(f.where(F.col("split") == "train"), xs=_XS)
    return rounded(models.evaluate(models.predict_multilinear(f.where(F.col("split") == "val"), m, xs=_XS)).select(
        "series_id", "mape", "rmse", "n"))


@register("candidate_multimodels", O.with_(*_BT_CTES, f"""hist12 AS (
  SELECT c.t, h.* FROM cand c JOIN features h ON h.series_id = c.series_id AND h.split IN ('train', 'test')
    AND h.ts >= c.t - to_microseconds({int(HOURLY_BACKTEST.refit_days * 86_400_000_000)}) AND h.ts <= c.t)""",
    *O.multilinear_ctes("ml", "hist12", _XS, "series_id, t"))
          + f"SELECT series_id, t, {rd('intercept')}, {_COEFS}, n_fit FROM ml")
def q_candidate_multimodels(spark, sf):
    """Refit candidates on all 12 features from running sums."""
    f = monitor.features(spark, sf)
    fit = BT.candidate_multimodels(f, monitor.windows(f), HOURLY_BACKTEST, _XS).where(F.col("n_fit") > 0)
    return _with_coefs(fit, "series_id", "t")


# ---------------------------------------------------------------- policies and backtest
_BT_COLS = ("series_id", "policy", "scenario", "window_id", "timestamp", "mape", "rmse", "psi",
            "ks_drifted", "overall_drift", "fire", "refit", "model_time")
_FOLD_SELECT = f"""SELECT series_id, policy, scenario, CAST(window_id AS BIGINT) AS window_id, window_start AS timestamp,
  {rd('mape')}, {rd('rmse')}, {rd('psi')}, CAST(ks_drifted AS INTEGER) AS ks_drifted, overall_drift, fire, refit, model_time"""


@register("backtest", O.with_(*_BT_CTES) + _FOLD_SELECT + " FROM fold")
def q_backtest(spark, sf):
    return rounded(monitor.backtest_metrics(spark, sf).select(*_BT_COLS))


_PUBLISHED = O.with_(
    """hourly AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) / 1000 AS value
      FROM orders GROUP BY 1, 2)""",
    *O.PREP[1:-1], O.features_cte(DAILY_SPLIT), O.windows_cte(REFERENCE_BACKTEST.window_size, REFERENCE_BACKTEST.step), *O.psi_ctes(),
    *O.ks_ctes(running=True), *O.model_ctes(REFERENCE_BACKTEST), *O.backtest_ctes(REFERENCE_POLICIES, DriftConfig(), REFERENCE_BACKTEST))


@register("backtest_published", _PUBLISHED + _FOLD_SELECT + " FROM fold")
def q_backtest_published(spark, sf):
    """The published settings on six years of orders: windows of 168 rows, 60 days of
    history, the four published policies."""
    f = prepare.order_features(spark, sf)
    cols = f.columns
    f = monitor.write_table(f, "order-features", partition_by="split").select(*cols)
    return rounded(BT.run_backtest(f, REFERENCE_BACKTEST, DriftConfig(), REFERENCE_POLICIES).select(*_BT_COLS))


@register("event_log", O.with_(*_BT_CTES) + """
SELECT series_id, policy, scenario, window_start AS timestamp, 'retrain' AS event,
  CAST(NULL AS DOUBLE) AS retrain_time_seconds, 'policy_trigger' AS trigger_reason
FROM fold WHERE refit""")
def q_event_log(spark, sf):
    return BT.event_log(monitor.backtest_metrics(spark, sf))


def _static_fires(spark, sf):
    return monitor.static_policy_fires(monitor.features(spark, sf)).select(
        "series_id", "policy", "scenario", F.col("window_id").cast("bigint"), "window_start", "fire")


_SFOLD = "SELECT series_id, policy, scenario, CAST(window_id AS BIGINT) AS window_id, window_start, fire FROM sfold"
register("apply_policies", O.with_(*_BT_CTES) + _SFOLD)(_static_fires)
for _name, _pol in (("policy_never", "policy0"), ("policy_periodic", "policy1"),
                    ("policy_performance", "policy2"), ("policy_hybrid", "policy3")):
    register(_name, O.with_(*_BT_CTES) + _SFOLD + f" WHERE policy = '{_pol}'")(
        (lambda p: lambda spark, sf: _static_fires(spark, sf).where(F.col("policy") == p))(_pol))


# ---------------------------------------------------------------- evaluation
from tsdrift.config import BOOTSTRAP_REPS, POLICY_NAMES  # noqa: E402
from tsdrift.operators import evaluate as E  # noqa: E402

_EVL_CTES = (*_BT_CTES, O.MET, O.EVENTS, O.SUMM)


def _runs(spark, sf):
    m = monitor.backtest_metrics(spark, sf)
    return m, BT.event_log(m)


def _summary(spark, sf):
    m, e = _runs(spark, sf)
    return E.run_summary(m, e)


_SUMM_COLS = ("series_id", "policy", "scenario", "mean_mape", "median_mape", "std_mape", "final_mape",
              "num_retrains", "total_retrain_time_seconds")


@register("run_summary", O.with_(*_EVL_CTES) + "SELECT series_id, policy, scenario, " + ", ".join(
    rd(c) for c in ("mean_mape", "median_mape", "std_mape", "final_mape")) + ", num_retrains, "
    + rd("total_retrain_time_seconds") + " FROM summ")
def q_run_summary(spark, sf):
    return rounded(_summary(spark, sf).select(*_SUMM_COLS))


@register("policy_metrics", O.with_(*_EVL_CTES) + f"""
SELECT s.series_id, s.policy, s.scenario, {rd('s.mean_mape', 'mean_mape')}, {rd('max(m.mape)', 'max_mape')},
  {rd('min(m.mape)', 'min_mape')}, s.num_retrains, {rd('0.0', 'mean_retrain_time')}
FROM summ s JOIN met m USING (series_id, policy, scenario) GROUP BY s.series_id, s.policy, s.scenario, s.mean_mape, s.num_retrains""")
def q_policy_metrics(spark, sf):
    m, e = _runs(spark, sf)
    return rounded(E.policy_metrics(m, e).select("series_id", "policy", "scenario", "mean_mape", "max_mape",
                                                 "min_mape", "num_retrains", "mean_retrain_time"))


@register("degradation_rate", O.with_(*_EVL_CTES) + f"""
SELECT series_id, policy, scenario, {rd('regr_slope(smooth, days)', 'degradation_rate')}
FROM (SELECT *, avg(mape) OVER (PARTITION BY series_id, policy, scenario ORDER BY window_id
                                ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS smooth,
        datediff('microsecond', min(timestamp) OVER (PARTITION BY series_id, policy, scenario), timestamp)
          / 86400000000.0 AS days
      FROM met) GROUP BY ALL""")
def q_degradation_rate(spark, sf):
    m, _ = _runs(spark, sf)
    return rounded(E.degradation_rate(m))


@register("smooth_rolling", O.with_(*_EVL_CTES) + f"""
SELECT series_id, policy, scenario, window_id, {rd('avg(mape) OVER (PARTITION BY series_id, policy, scenario ORDER BY window_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'smooth')}
FROM met""")
def q_smooth_rolling(spark, sf):
    m, _ = _runs(spark, sf)
    # a 3-window frame so partial and full frames both occur on the short runs
    return rounded(features.smooth_rolling(m, "mape", "window_id", E.RUN, 3, "smooth")
                   .select("series_id", "policy", "scenario", "window_id", "smooth"))


@register("bootstrap_ci", O.with_(*_EVL_CTES, "bsrc AS (SELECT series_id, policy, scenario, window_id, mape AS v FROM met)",
                                  *O.bootstrap_ctes("boot", "bsrc", "series_id, policy, scenario", BOOTSTRAP_REPS))
          + f"SELECT series_id, policy, scenario, {rd('mean')}, {rd('ci_lower')}, {rd('ci_upper')} FROM boot")
def q_bootstrap_ci(spark, sf):
    m, _ = _runs(spark, sf)
    return rounded(E.bootstrap_ci(m, E.RUN))


_PAIR_CTES = (*_EVL_CTES, O.pairs_cte())


def _pairs(spark, sf):
    m, _ = _runs(spark, sf)
    mine = m.where(F.col("policy") == "policy3")
    other = m.where(F.col("policy").isin("policy0", "policy1")).withColumnRenamed("policy", "other_policy")
    return joins.paired_metrics(mine, other, ["series_id", "scenario"])


@register("paired_metrics", O.with_(*_PAIR_CTES)
          + f"SELECT series_id, scenario, other_policy, window_id, {rd('a')}, {rd('b')} FROM pr")
def q_paired_metrics(spark, sf):
    return rounded(_pairs(spark, sf).select("series_id", "scenario", "other_policy", "window_id", "a", "b"))


@register("wilcoxon_signed_rank", O.with_(*_PAIR_CTES, *O.WILCOXON)
          + f"SELECT series_id, scenario, other_policy, n_nonzero, {rd('statistic')}, {rd('p_value')} FROM wil")
def q_wilcoxon(spark, sf):
    w = E.wilcoxon_signed_rank(_pairs(spark, sf), ["series_id", "scenario", "other_policy"])
    return rounded(w.select("series_id", "scenario", "other_policy", "n_nonzero", "statistic", "p_value"))


@register("cohens_d", O.with_(*_PAIR_CTES, *O.WILCOXON)
          + f"SELECT series_id, scenario, other_policy, {rd('cohens_d')} FROM cd")
def q_cohens_d(spark, sf):
    return rounded(E.cohens_d(_pairs(spark, sf), ["series_id", "scenario", "other_policy"]))


_CMP_CTES = (*_PAIR_CTES, *O.WILCOXON,
             "ba_src AS (SELECT series_id, scenario, other_policy, window_id, a AS v FROM pr)",
             *O.bootstrap_ctes("ba", "ba_src", "series_id, scenario, other_policy", BOOTSTRAP_REPS),
             "bb_src AS (SELECT series_id, scenario, other_policy, window_id, b AS v FROM pr)",
             *O.bootstrap_ctes("bb", "bb_src", "series_id, scenario, other_policy", BOOTSTRAP_REPS))


@register("compare_policies", O.with_(*_CMP_CTES) + f"""
SELECT w.series_id, w.scenario, w.other_policy, {rd('ba.mean', 'a_mean')}, {rd('ba.ci_lower', 'a_ci_lower')},
  {rd('ba.ci_upper', 'a_ci_upper')}, {rd('bb.mean', 'b_mean')}, {rd('bb.ci_lower', 'b_ci_lower')},
  {rd('bb.ci_upper', 'b_ci_upper')}, {rd('w.statistic', 'statistic')}, {rd('w.p_value', 'p_value')},
  w.p_value < 0.05 AS significant, {rd('cd.cohens_d', 'cohens_d')}
FROM wil w JOIN cd USING ({O.K3}) JOIN ba USING ({O.K3}) JOIN bb USING ({O.K3})""")
def q_compare_policies(spark, sf):
    m, _ = _runs(spark, sf)
    c = E.compare_policies(m, "policy3", ["policy0", "policy1"])
    return rounded(c.select("series_id", "scenario", "other_policy", "a_mean", "a_ci_lower", "a_ci_upper",
                            "b_mean", "b_ci_lower", "b_ci_upper", "statistic", "p_value", "significant",
                            "cohens_d"))


@register("significance_table", O.with_(*_PAIR_CTES, *O.WILCOXON) + f"""
SELECT w.series_id, w.scenario, 'P3 vs ' || w.other_policy AS comparison, {rd('w.p_value', 'p_value')},
  {rd('cd.cohens_d', 'cohens_d')}, w.p_value < 0.05 AS significant
FROM wil w JOIN cd USING ({O.K3})""")
def q_significance_table(spark, sf):
    m, _ = _runs(spark, sf)
    return rounded(E.significance_table(m))


@register("performance_table", O.with_(*_EVL_CTES) + f"""
SELECT series_id, policy AS "Policy", scenario AS "Scenario", round({O.snap('mean_mape')}, 2) AS "Mean MAPE",
  round({O.snap('std_mape')}, 2) AS "Std Dev", num_retrains AS "Retrains",
  round({O.snap('total_retrain_time_seconds')}, 2) AS "Time (s)" FROM summ""")
def q_performance_table(spark, sf):
    s = rounded(_summary(spark, sf))
    return E.performance_table(s)


@register("pareto_frontier", O.with_(*_EVL_CTES) + f"""
SELECT series_id, scenario, policy, num_retrains, {rd('mean_mape')}
FROM (SELECT *, min(mean_mape) OVER (PARTITION BY series_id, scenario ORDER BY num_retrains, mean_mape, policy
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM summ)
WHERE best_before IS NULL OR mean_mape < best_before""")
def q_pareto_frontier(spark, sf):
    return rounded(E.pareto_frontier(_summary(spark, sf)))


@register("running_min_before", O.with_(*_EVL_CTES) + f"""
SELECT series_id, scenario, policy, {rd('min(mean_mape) OVER (PARTITION BY series_id, scenario ORDER BY num_retrains, mean_mape, policy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'best_before')}
FROM summ""")
def q_running_min_before(spark, sf):
    s = features.running_min_before(_summary(spark, sf), "mean_mape", ["num_retrains", "mean_mape", "policy"],
                                    ["series_id", "scenario"])
    return rounded(s.select("series_id", "scenario", "policy", "best_before"))


@register("retrain_pivot", O.with_(*_EVL_CTES) + "SELECT series_id, scenario, " + ", ".join(
    f"max(CASE WHEN policy = '{p}' THEN num_retrains END) AS {p}" for p in POLICY_NAMES)
    + " FROM summ GROUP BY ALL")
def q_retrain_pivot(spark, sf):
    return E.retrain_pivot(_summary(spark, sf), POLICY_NAMES)


@register("box_stats", O.with_(*_EVL_CTES) + f"""
SELECT series_id, policy, scenario, {rd('q_min')}, {rd('q1')}, {rd('median')}, {rd('q3')}, {rd('q_max')},
  {rd('min(CASE WHEN mape >= q1 - 1.5 * (q3 - q1) AND mape <= q3 + 1.5 * (q3 - q1) THEN mape END)', 'whisker_low')},
  {rd('max(CASE WHEN mape >= q1 - 1.5 * (q3 - q1) AND mape <= q3 + 1.5 * (q3 - q1) THEN mape END)', 'whisker_high')},
  count_if(NOT (mape >= q1 - 1.5 * (q3 - q1) AND mape <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM met JOIN (SELECT series_id, policy, scenario, quantile_cont(mape, 0.0) AS q_min, quantile_cont(mape, 0.25) AS q1,
                 quantile_cont(mape, 0.5) AS median, quantile_cont(mape, 0.75) AS q3, quantile_cont(mape, 1.0) AS q_max
               FROM met GROUP BY ALL) q USING (series_id, policy, scenario)
GROUP BY series_id, policy, scenario, q_min, q1, median, q3, q_max""")
def q_box_stats(spark, sf):
    m, _ = _runs(spark, sf)
    return rounded(E.box_stats(m))


@register("drift_signals_long", O.with_(*_EVL_CTES) + f"""
SELECT series_id, policy, scenario, window_id, timestamp, signal, {rd('value')},
  CASE signal WHEN 'psi' THEN 0.25 WHEN 'ks_drifted' THEN 3.0 END AS threshold
FROM (UNPIVOT (SELECT series_id, policy, scenario, window_id, timestamp, CAST(psi AS DOUBLE) AS psi,
                      CAST(ks_drifted AS DOUBLE) AS ks_drifted, CAST(mape AS DOUBLE) AS mape FROM met)
      ON psi, ks_drifted, mape INTO NAME signal VALUE value)""")
def q_drift_signals_long(spark, sf):
    m, _ = _runs(spark, sf)
    return rounded(E.drift_signals_long(m))


@register("annotated_events", O.with_(*_EVL_CTES) + f"""
SELECT e.series_id, e.policy, e.scenario, e.timestamp,
  {rd("coalesce((SELECT m.mape FROM met m WHERE m.series_id = e.series_id AND m.policy = e.policy AND m.scenario = e.scenario AND m.timestamp >= e.timestamp ORDER BY m.timestamp LIMIT 1), (SELECT arg_max(m.mape, m.timestamp) FROM met m WHERE m.series_id = e.series_id AND m.policy = e.policy AND m.scenario = e.scenario))", 'mape')}
FROM ev e""")
def q_annotated_events(spark, sf):
    m, e = _runs(spark, sf)
    return rounded(E.annotated_events(m, e))


@register("asof_forward", O.with_(*_BT_CTES, """wm AS (
  SELECT w.series_id, w.scenario, w.window_start AS t, pr.mape
  FROM (SELECT DISTINCT series_id, scenario, window_id, window_start FROM win) w
  JOIN pairs pr ON pr.series_id = w.series_id AND pr.scenario = w.scenario AND pr.window_id = w.window_id AND pr.mt IS NULL)""",
    "wlast AS (SELECT series_id, scenario, arg_max(mape, t) AS mape FROM wm GROUP BY ALL)") + f"""
SELECT p.series_id, p.scenario, p.ts AS timestamp, {rd('coalesce(wm.mape, l.mape)', 'mape')}
FROM pos_rows p ASOF LEFT JOIN wm ON wm.series_id = p.series_id AND wm.scenario = p.scenario AND p.ts <= wm.t
JOIN wlast l ON l.series_id = p.series_id AND l.scenario = p.scenario""")
def q_asof_forward(spark, sf):
    """JON-1: every hour of the test period with the MAPE of the next window."""
    f = monitor.features(spark, sf)
    windows_ = monitor.static_scores(f).select("series_id", "scenario", F.col("window_start").alias("timestamp"), "mape")
    hours = f.where(F.col("split") == "test").select("series_id", "scenario", F.col("ts").alias("timestamp"))
    return rounded(joins.asof_forward(hours, windows_, ["series_id", "scenario"]))


@register("cost_accuracy_points", O.with_(*_EVL_CTES) + f"SELECT series_id, policy, scenario, num_retrains, {rd('mean_mape')} FROM summ")
def q_cost_accuracy_points(spark, sf):
    return rounded(E.cost_accuracy_points(_summary(spark, sf)))


@register("top_k", O.with_(*_EVL_CTES) + f"""
SELECT series_id, policy, scenario, {rd('mean_mape')}, num_retrains FROM summ
ORDER BY mean_mape, series_id, policy, scenario LIMIT 10""")
def q_top_k(spark, sf):
    return rounded(E.top_k(_summary(spark, sf)).select("series_id", "policy", "scenario", "mean_mape", "num_retrains"))


@register("experiment_grid", O.with_(*O.PREP) + "SELECT p.policy, s.scenario FROM (SELECT DISTINCT scenario FROM features "
          "WHERE scenario IS NOT NULL) s, (SELECT unnest(['" + "', '".join(POLICY_NAMES) + "']) AS policy) p")
def q_experiment_grid(spark, sf):
    return joins.experiment_grid(POLICY_NAMES, prepare.hourly_features(spark, sf))


# ---------------------------------------------------------------- daily fixture, parsing, filters
from tsdrift.config import DriftConfig  # noqa: E402
from tsdrift.sources import readings  # noqa: E402
from tsdrift.sources.fixtures import table  # noqa: E402

_DAILY = O.with_(O.DAILY, O.DAILY_FEAT)


@register("season", _DAILY + "SELECT series_id, ts, month, season FROM dfeat")
def q_season(spark, sf):
    return prepare.daily_features(spark, sf).select("series_id", "ts", "month", "season")


@register("is_weekend", _DAILY + "SELECT series_id, ts, day_of_week, is_weekend FROM dfeat")
def q_is_weekend(spark, sf):
    return prepare.daily_features(spark, sf).select("series_id", "ts", "day_of_week", "is_weekend")


@register("holiday_flag", _DAILY + "SELECT series_id, ts, is_holiday FROM dfeat")
def q_holiday_flag(spark, sf):
    return prepare.daily_features(spark, sf).select("series_id", "ts", "is_holiday")


@register("chronological_split", _DAILY + "SELECT series_id, ts, split FROM dfeat")
def q_chronological_split(spark, sf):
    return prepare.daily_features(spark, sf).select("series_id", "ts", "split")


@register("label_scenarios", _DAILY + "SELECT series_id, ts, split, scenario FROM dfeat")
def q_label_scenarios(spark, sf):
    return prepare.daily_features(spark, sf).select("series_id", "ts", "split", "scenario")


@register("filter_scenario", _DAILY + f"SELECT series_id, ts, {rd('value')} FROM dfeat WHERE scenario = 'holiday_drift'")
def q_filter_scenario(spark, sf):
    return rounded(scenarios.filter_scenario(prepare.daily_features(spark, sf), "holiday_drift")
                   .select("series_id", "ts", "value"))


@register("row_position", _DAILY + """
SELECT series_id, scenario, ts, row_number() OVER (PARTITION BY series_id, scenario ORDER BY ts) - 1 AS pos
FROM dfeat WHERE split = 'test'""")
def q_row_position(spark, sf):
    d = prepare.daily_features(spark, sf).where(F.col("split") == "test")
    return scenarios.row_position(d, ["series_id", "scenario"]).select("series_id", "scenario", "ts", "pos")


@register("split_at_fraction", O.with_(*O.PREP) + """
SELECT series_id, ts, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1
  < floor(count(*) OVER (PARTITION BY series_id) * 0.5) THEN 'first' ELSE 'second' END AS part
FROM features WHERE split = 'val'""")
def q_split_at_fraction(spark, sf):
    v = prepare.hourly_features(spark, sf).where(F.col("split") == "val")
    return scenarios.split_at_fraction(v, 0.5).select("series_id", "ts", "part")


@register("last_rows", O.with_(*O.PREP) + f"""
SELECT series_id, ts, {rd('load')} FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM features WHERE split = 'test')
WHERE r <= 24""")
def q_last_rows(spark, sf):
    t = prepare.hourly_features(spark, sf).where(F.col("split") == "test")
    return rounded(scenarios.last_rows(t, 24).select("series_id", "ts", "load"))


_RAW_SQL = """raw AS (
  SELECT event_type AS series_id, strftime(ts, '%d/%m/%Y') AS "Date", strftime(ts, '%H:%M:%S') AS "Time",
    CAST(value AS VARCHAR) AS reading, props FROM events)"""


def _raw_text(spark, sf):
    """Events written out as the text readings the raw source holds."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("series_id"), F.date_format("ts", "dd/MM/yyyy").alias("Date"),
                    F.date_format("ts", "HH:mm:ss").alias("Time"),
                    F.col("value").cast("string").alias("reading"), "props")


@register("parse_timestamp", O.with_(_RAW_SQL) + """
SELECT series_id, strptime("Date" || ' ' || "Time", '%d/%m/%Y %H:%M:%S') AS ts FROM raw""")
def q_parse_timestamp(spark, sf):
    r = _raw_text(spark, sf)
    return r.select("series_id", readings.parse_timestamp(F.col("Date"), F.col("Time")).alias("ts"))


@register("coerce_numeric", O.with_(_RAW_SQL) + f"""
SELECT series_id, {rd("CASE WHEN reading IN ('?', 'nan', '') THEN NULL ELSE TRY_CAST(reading AS DOUBLE) END", 'value')},
  CASE WHEN props IN ('?', 'nan', '') THEN NULL ELSE TRY_CAST(props AS DOUBLE) END AS props_value FROM raw""")
def q_coerce_numeric(spark, sf):
    r = _raw_text(spark, sf)
    return rounded(r.select("series_id", readings.coerce_numeric("reading").alias("value"),
                            readings.coerce_numeric("props").alias("props_value")))


@register("project_target", O.with_(_RAW_SQL) + f"""
SELECT series_id, strptime("Date" || ' ' || "Time", '%d/%m/%Y %H:%M:%S') AS ts,
  {rd("TRY_CAST(reading AS DOUBLE)", 'value')} FROM raw""")
def q_project_target(spark, sf):
    s = readings.readings_to_series(_raw_text(spark, sf), "series_id", value="reading")
    return rounded(features.project_target(s, "ts", "value"))


@register("split_features_target", O.with_(*O.PREP) + "SELECT series_id, ts, " + ", ".join(
    rd(c) if c.startswith("load") else c for c in O.FEATURE_COLS) + " FROM features")
def q_split_features_target(spark, sf):
    x, _ = features.split_features_target(prepare.hourly_features(spark, sf))
    return rounded(x)


@register("drop_incomplete", O.with_(*O.PREP) + f"SELECT series_id, ts, {rd('load', 'value')}, {rd('load_lag_168h')}, "
          f"{rd('load_roll_std_24h')} FROM features")
def q_drop_incomplete(spark, sf):
    d = features.drop_incomplete(features.lag_rolling(prepare.hourly_repaired(spark, sf)))
    return rounded(d.select("series_id", "ts", "value", "load_lag_168h", "load_roll_std_24h"))


@register("scalar_math", O.with_(*O.PREP) + f"""
SELECT series_id, ts, {rd('abs(load - load_lag_1h)', 'abs_change')}, {rd('sqrt(load)', 'sqrt_load')},
  {rd('ln(load + 1.0)', 'log_load')}, {rd('(load - load_lag_24h) / (load_lag_24h + 1e-08)', 'rel_change')},
  {rd('CASE WHEN load_lag_168h = 0 THEN 1e-10 ELSE load_lag_168h END', 'guarded')}
FROM features""")
def q_scalar_math(spark, sf):
    f = prepare.hourly_features(spark, sf)
    return rounded(f.select(
        "series_id", "ts", F.abs(F.col("load") - F.col("load_lag_1h")).alias("abs_change"),
        F.sqrt("load").alias("sqrt_load"), F.ln(F.col("load") + 1.0).alias("log_load"),
        ((F.col("load") - F.col("load_lag_24h")) / (F.col("load_lag_24h") + 1e-8)).alias("rel_change"),
        F.when(F.col("load_lag_168h") == 0, F.lit(1e-10)).otherwise(F.col("load_lag_168h")).alias("guarded")))


# DRF-10: validation-period stability check and long-term drift check.
VALIDATION_DRIFT = DriftConfig(ks_drift_count=2, mape_alpha=1.10, mape_beta=1.25)


def drift_validation(spark, sf):
    """Reference = first half of validation; check A = second half; check B =
    long-term-drift test rows (else the last 1000 test rows of the series)."""
    f = monitor.features(spark, sf)
    val = scenarios.split_at_fraction(f.where(F.col("split") == "val"), 0.5)
    ref = val.where(F.col("part") == "first")
    test = f.where(F.col("split") == "test")
    labelled_b = test.where(F.col("scenario") == "long_term_drift")
    fallback = scenarios.last_rows(test.join(labelled_b.select("series_id").distinct(), "series_id", "left_anti"), 1000)
    cur = (val.where(F.col("part") == "second").drop("part").withColumn("check_id", F.lit("A"))
           .unionByName(labelled_b.unionByName(fallback).withColumn("check_id", F.lit("B"))))
    cfg = VALIDATION_DRIFT
    d = drift.window_drift(ref, cur, cfg, "load", window_keys=("check_id",))
    m0 = models.fit_grouped_linear(f.where(F.col("split") == "train"), x=HOURLY_BACKTEST.x_col)
    base = models.evaluate(models.predict_linear(ref, m0)).select("series_id", F.col("mape").alias("baseline_mape"))
    cm = models.evaluate(models.predict_linear(cur, m0), by=["series_id", "check_id"]).select("series_id", "check_id", "mape")
    out = drift.mape_check(cm.join(base, "series_id"), alpha=cfg.mape_alpha, beta=cfg.mape_beta).join(d, ["series_id", "check_id"])
    out = out.withColumn("overall_drift", F.col("psi_drift") | F.coalesce("ks_drift", F.lit(False)) | F.col("mape_drift"))
    return out


_DV_CTES = (*O.PREP, *O.model_ctes(),
            """vpos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS p,
                 count(*) OVER (PARTITION BY series_id) AS n FROM features WHERE split = 'val')""",
            "vref AS (SELECT * EXCLUDE (p, n) FROM vpos WHERE p < floor(n * 0.5))",
            """vcur AS (SELECT * EXCLUDE (p, n), 'A' AS check_id FROM vpos WHERE p >= floor(n * 0.5)
                 UNION ALL SELECT *, 'B' AS check_id FROM features WHERE scenario = 'long_term_drift')""",
            *O.psi_ctes(ref_where="TRUE", cur="vcur", wkeys=("check_id",), ref_src="vref"),
            *O.ks_ctes(ref_where="TRUE", cur="vcur", wkeys=("check_id",), ref_src="vref"),
            """vbase AS (SELECT r.series_id, avg(abs((r.load - (m.a + m.b * r.load_lag_24h)) / (r.load + 1e-08))) * 100 AS baseline_mape
               FROM vref r JOIN m0 m USING (series_id) GROUP BY 1)""",
            """vm AS (SELECT c.series_id, c.check_id, avg(abs((c.load - (m.a + m.b * c.load_lag_24h)) / (c.load + 1e-08))) * 100 AS mape
               FROM vcur c JOIN m0 m USING (series_id) GROUP BY ALL)""")


@register("drift_validation", O.with_(*_DV_CTES) + f"""
SELECT v.series_id, v.check_id, {rd('ps.psi', 'psi')}, {O.psi_drift_sql('ps.psi')} AS psi_drift,
  coalesce(kv.ks_num_drifted, 0) AS ks_num_drifted, {rd('v.mape', 'mape')}, {rd('b.baseline_mape', 'baseline_mape')},
  {rd('v.mape / b.baseline_mape', 'mape_ratio')}, v.mape / b.baseline_mape >= 1.25 AS mape_drift,
  ({O.psi_drift_sql('ps.psi')} OR coalesce(kv.ks_num_drifted, 0) >= 2 OR v.mape / b.baseline_mape >= 1.25) AS overall_drift
FROM vm v JOIN vbase b USING (series_id) JOIN psi_t ps USING (series_id, check_id)
LEFT JOIN ks_v kv USING (series_id, check_id)""")
def q_drift_validation(spark, sf):
    d = drift_validation(spark, sf)
    return rounded(d.select("series_id", "check_id", "psi", "psi_drift",
                            F.coalesce(F.col("ks_num_drifted"), F.lit(0)).cast("int").alias("ks_num_drifted"),
                            "mape", "baseline_mape", "mape_ratio", "mape_drift", "overall_drift"))


# ---------------------------------------------------------------- sources, sinks, forecaster, report (rows checks)
from tsdrift.sources import files  # noqa: E402


@register("read_readings", O.with_(_RAW_SQL) + f"""
SELECT series_id, strptime("Date" || ' ' || "Time", '%d/%m/%Y %H:%M:%S') AS ts,
  {rd("TRY_CAST(reading AS DOUBLE)", 'value')} FROM raw""")
def q_read_readings(spark, sf):
    """SRC-1: events written as ';'-separated text with '?' for missing
    values, read back with every column as text, then parsed."""
    path = files.run_folder(spark, "readings")
    raw = _raw_text(spark, sf).select("series_id", "Date", "Time",
                                      F.coalesce(F.col("reading"), F.lit("?")).alias("Global_active_power"))
    raw.write.option("header", True).option("sep", ";").csv(path)
    text = readings.read_readings(spark, path, cols=("series_id", "Date", "Time", "Global_active_power"))
    return rounded(readings.readings_to_series(text, "series_id"))


_SPLIT_COLS = ("load", *O.FEATURE_COLS)
_SPLIT_SQL = "SELECT series_id, ts, " + ", ".join(rd(c) if c.startswith("load") else c for c in _SPLIT_COLS) + ", split, scenario FROM features"


def _written_splits(spark, sf) -> str:
    path = files.run_folder(spark, "splits")
    files.write_splits(monitor.features(spark, sf), path)
    return path


@register("write_splits", O.with_(*O.PREP) + _SPLIT_SQL)
def q_write_splits(spark, sf):
    """SNK-1: the labelled feature table written by split, all of it read back."""
    return rounded(spark.read.parquet(_written_splits(spark, sf)))


@register("read_split", O.with_(*O.PREP) + _SPLIT_SQL + " WHERE split = 'test'")
def q_read_split(spark, sf):
    """SRC-2: one split reloaded (partition-pruned)."""
    return rounded(files.read_split(spark, _written_splits(spark, sf), "test"))


def _written_logs(spark, sf) -> str:
    path = files.run_folder(spark, "runs")
    files.write_run_logs(*_runs(spark, sf), path)
    return path


@register("write_run_logs", O.with_(*_BT_CTES) + _FOLD_SELECT + " FROM fold")
def q_write_run_logs(spark, sf):
    """SNK-2: the metric log persisted by run and read back."""
    return rounded(spark.read.parquet(f"{_written_logs(spark, sf)}/metrics").select(*_BT_COLS))


@register("read_run_logs", ORACLE["event_log"])
def q_read_run_logs(spark, sf):
    """SRC-3: run keys come from the folders; the event log of every run."""
    _, events = files.read_run_logs(spark, _written_logs(spark, sf))
    return events.select("series_id", "policy", "scenario", "timestamp", "event", "retrain_time_seconds", "trigger_reason")


_RUN_ID = "scenario || '-' || series_id"


@register("read_run_log_files", O.with_(*_BT_CTES) + f"""
SELECT policy, {_RUN_ID} AS scenario, count(*) AS windows, {rd('avg(mape)', 'mean_mape')}, {rd('max(psi)', 'max_psi')},
  count_if(overall_drift) AS drifted, count_if(refit) AS retrains, bool_or(refit) AS has_event_log, max(CASE WHEN refit THEN window_start END) AS last_retrain
FROM fold GROUP BY ALL""")
def q_read_run_log_files(spark, sf):
    """SRC-3: the backtest's logs as CSV files in a folder per policy and scenario
    (here one per series, too), beside stray files; runs that never retrained have
    no event log."""
    m, _ = _runs(spark, sf)
    m = m.withColumn("run", F.concat_ws("-", "scenario", "series_id"))
    root = files.run_folder(spark, "run-files")
    files.write_run_log_files(m, BT.event_log(m.drop("scenario").withColumnRenamed("run", "scenario")).withColumnRenamed("scenario", "run"),
                              root, ("policy", "run"))
    m.select("timestamp", "mape").write.csv(f"{root}/policy3_metrics.csv")  # stray output above the run folders
    m.select("mape").write.csv(f"{root}/policy0/notes/summary.csv")
    metrics, events, known = files.read_run_log_files(spark, root)
    per_run = metrics.groupBy("policy", "scenario").agg(
        F.count("*").alias("windows"), F.avg("mape").alias("mean_mape"), F.max("psi").alias("max_psi"), F.count_if("overall_drift").alias("drifted"))
    per_log = events.groupBy("policy", "scenario").agg(F.count("*").alias("retrains"), F.max("timestamp").alias("last_retrain"))
    out = known.join(per_run, ["policy", "scenario"], "left").join(per_log, ["policy", "scenario"], "left").fillna({"retrains": 0})
    return rounded(out.select("policy", "scenario", "windows", "mean_mape", "max_psi", "drifted", "retrains", "has_event_log", "last_retrain"))


@register("write_summary", ORACLE["run_summary"])
def q_write_summary(spark, sf):
    """SNK-3: the summary of the reloaded logs, written and read back."""
    path = _written_logs(spark, sf)
    files.write_summary(E.run_summary(*files.read_run_logs(spark, path)), f"{path}/summary")
    return rounded(spark.read.parquet(f"{path}/summary").select(*_SUMM_COLS))


def _gbt_model(spark, sf):
    f = monitor.features(spark, sf)
    return models.fit_forecaster(f.where(F.col("split") == "train")), f


@register("fit_forecaster")
def q_fit_forecaster(spark, sf):
    """MDL-1/2/3: boosted trees on the training split, scored on validation."""
    model, f = _gbt_model(spark, sf)
    return models.evaluate(models.predict(model, f.where(F.col("split") == "val")))


@register("feature_importance")
def q_feature_importance(spark, sf):
    """MDL-4: top 10 features of the fitted trees."""
    model, _ = _gbt_model(spark, sf)
    return models.feature_importance(model, top=10)


@register("save_model")
def q_save_model(spark, sf):
    """SNK-4: save, reload and score with the reloaded model."""
    model, f = _gbt_model(spark, sf)
    path = files.run_folder(spark, "model")
    models.save_model(model, path)
    return models.predict(models.load_model(path), f.where(F.col("split") == "val")).select(
        "series_id", "ts", "prediction")


@register("timeseries_folds", O.with_(*O.PREP) + """
SELECT series_id, ts, CAST(CASE WHEN p < n - (n // 4) * 3 THEN 0 ELSE (p - (n - (n // 4) * 3)) // (n // 4) + 1 END AS INTEGER) AS part
FROM (SELECT series_id, ts, row_number() OVER (ORDER BY ts, series_id) - 1 AS p, count(*) OVER () AS n
      FROM features WHERE split = 'train')""")
def q_timeseries_folds(spark, sf):
    t = monitor.features(spark, sf).where(F.col("split") == "train").select("series_id", "ts")
    return models.timeseries_folds(t, 3, tiebreak=["series_id"]).select("series_id", "ts", "part")


@register("tune")
def q_tune(spark, sf):
    """MDL-5: seeded random search over expanding time folds."""
    f = monitor.features(spark, sf).where(F.col("split") == "train")
    _, table = models.tune(f)
    return table


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 'True' ELSE 'False' END"


_REPORT_SQL = O.with_(*_BT_CTES, f"""mon AS (
  SELECT w.series_id, w.scenario, w.window_id, w.window_start, ps.psi, {O.psi_severity_sql('ps.psi')} AS psi_severity,
    {O.psi_drift_sql('ps.psi')} AS psi_drift, coalesce(kv.ks_num_drifted, 0) AS ks_num_drifted, kv.drifted_features,
    coalesce(kv.ks_num_drifted, 0) >= {HOURLY_DRIFT.ks_drift_count} AS ks_drift, pr.mape, b.baseline_mape,
    pr.mape / b.baseline_mape AS ratio
  FROM (SELECT DISTINCT series_id, scenario, window_id, window_start FROM win) w
  JOIN psi_t ps USING (series_id, scenario, window_id)
  LEFT JOIN ks_v kv USING (series_id, scenario, window_id)
  JOIN pairs pr ON pr.series_id = w.series_id AND pr.scenario = w.scenario AND pr.window_id = w.window_id AND pr.mt IS NULL
  JOIN base b ON b.series_id = w.series_id)""") + f"""
SELECT series_id, scenario, window_id, concat_ws(chr(10), '=== Drift Detection Summary ===',
  'Timestamp: ' || strftime(window_start, '%Y-%m-%d %H:%M:%S'),
  'Overall Drift Detected: ' || {_flag(f'psi_drift OR ks_drift OR ratio >= {HOURLY_DRIFT.mape_beta}')},
  printf('[PSI] Value: %.4f, Severity: %s, Drift: %s', psi, psi_severity, {_flag('psi_drift')}),
  '[KS Test] Drifted features: ' || ks_num_drifted || ', Drift: ' || {_flag('ks_drift')},
  CASE WHEN ks_num_drifted > 0 THEN '  Features: [''' || replace(drifted_features, ',', ''', ''') || ''']' END,
  printf('[MAPE Monitor] Ratio: %.2fx baseline', ratio),
  printf('  Base: %.2f%%, Recent: %.2f%%', baseline_mape, mape),
  '  Severity: ' || CASE WHEN ratio >= {HOURLY_DRIFT.mape_beta} THEN 'critical' WHEN ratio >= {HOURLY_DRIFT.mape_alpha} THEN 'warning'
    ELSE 'stable' END || ', Drift: ' || {_flag(f'ratio >= {HOURLY_DRIFT.mape_beta}')}) AS report
FROM mon"""


@register("drift_report", _REPORT_SQL)
def q_drift_report(spark, sf):
    """STR-F1: the multi-line text summary of each window's drift check."""
    m = monitor.static_monitor(monitor.features(spark, sf))
    return drift.drift_report(m).select("series_id", "scenario", "window_id", "report")


@register("stream_drift", O.with_(
    "sref AS (SELECT event_type AS series_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-16')",
    "scur AS (SELECT event_type AS series_id, ts, value, date_trunc('day', ts)::TIMESTAMP AS window_start FROM events WHERE ts >= TIMESTAMP '2024-01-16')",
    *O.psi_ctes("value", cur="scur", wkeys=("window_start",), ref_src="sref", ref_where="TRUE")) + f"""
SELECT series_id, window_start, window_start + INTERVAL 1 DAY AS window_end, {rd('psi')}, {O.psi_severity_sql()} AS psi_severity,
  {O.psi_drift_sql()} AS psi_drift FROM psi_t""")
def q_stream_drift(spark, sf):
    """STM-1: the event stream (file source, availableNow) scored per day
    against the training period."""
    from tsdrift.sources.fixtures import event_readings
    from tsdrift.streaming import drift_stream

    base = files.run_folder(spark, "stream")
    ev = event_readings(spark, sf)
    ev.where(F.col("ts") >= "2024-01-16").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{base}/in")
    q = drift_stream.start_stream_drift(stream, ev.where(F.col("ts") < "2024-01-16"), f"{base}/out", f"{base}/ck")
    q.awaitTermination()
    drift_stream.close_open_windows(ev.where(F.col("ts") >= "2024-01-16"), ev.where(F.col("ts") < "2024-01-16"), f"{base}/out")
    return rounded(drift_stream.read_windows(spark, f"{base}/out").select(
        "series_id", "window_start", "window_end", "psi", "psi_severity", "psi_drift"))


@register("stream_policy", O.with_(*_BT_CTES) + "SELECT series_id, policy, scenario, window_start, fire FROM sfold")
def q_stream_policy(spark, sf):
    """STM-2: the initial model's scored windows replayed as a file stream;
    policy state (last trigger, windows ahead of the watermark) kept per run and
    policy in the state store; a closing window ends the replay."""
    from tsdrift.functions.timecols import epoch_micros, from_epoch_micros
    from tsdrift.streaming import policy_stream

    base = files.run_folder(spark, "policy-stream")
    sig = monitor.static_monitor(monitor.features(spark, sf)).select(
        "series_id", "scenario", epoch_micros("window_start").alias("t_us"), "mape", "baseline_mape",
        "overall_drift")
    sig.write.parquet(f"{base}/in")
    policy_stream.closing_window(spark.read.parquet(f"{base}/in"), ("series_id", "scenario")).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(sig.schema).parquet(f"{base}/in")
    q = (policy_stream.stream_policy(stream, list(HOURLY_POLICIES), ("series_id", "scenario"))
         .writeStream.outputMode("append")
         .option("checkpointLocation", f"{base}/ck").format("parquet").option("path", f"{base}/out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "series_id", "policy", "scenario", from_epoch_micros("t_us").alias("window_start"), "fire")
