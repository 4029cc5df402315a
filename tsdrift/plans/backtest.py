"""Closed-loop retraining backtest as table work (POL-5, POL-6, DRF-9).

The published loop walks the test windows one by one: score the window with
the active model, measure drift, let the policy decide, refit on the last
``refit_days`` of history, move on.  Here:

1. candidate models - a refit at window time t depends only on history in
   [t - refit_days, t], never on the policy, so every candidate is fitted at
   once, from running sums of products per day (MDL-8; the shuffle does not
   depend on refit_days / step);
2. model-free drift (PSI, KS vote) per window, computed once for all policies;
3. the policy fold - per run key (series, policy, scenario) the windows are
   folded in order with ``aggregate``; each window element carries its own
   rows (at most ``window_size`` (x, y) pairs), so the active model scores it
   inside the fold and every window is scored exactly once.  Windows are
   folded ``chunk_windows`` at a time: a fold group never holds more than
   chunk_windows * window_size rows however long the series, and the small
   per-key state (coefficients, last trigger) is checkpointed between rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.config import MAPE_BASE_ZERO_GUARD, MAPE_EPSILON, BacktestConfig, DriftConfig, PolicySpec
from tsdrift.functions.timecols import epoch_micros, from_epoch_micros
from tsdrift.operators import drift, joins, models, policies
from tsdrift.operators.scenarios import forecast_windows
from tsdrift.session import materialize as write_table

RUN = ("series_id", "policy", "scenario")
OUT_T = ("array<struct<window_id:bigint,t_us:bigint,mape:double,rmse:double,psi:double,"
         "ks_drifted:int,overall_drift:boolean,fire:boolean,refit:boolean,model_us:bigint>>")
POLICY_COLS = ("kind", "retrain_interval_days", "mape_threshold", "min_retrain_interval_hours",
               "use_drift_signals")


def initial_model(features: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Model 0 fitted on the training split, and its validation MAPE."""
    m0 = models.fit_grouped_linear(features.where(F.col("split") == "train"), x=cfg.x_col, y=cfg.y_col)
    val = models.predict_linear(features.where(F.col("split") == "val"), m0, x=cfg.x_col)
    base = models.evaluate(val, cfg.y_col, "prediction").select("series_id", F.col("mape").alias("baseline_mape"))
    return m0.join(base, "series_id", "left")


def range_products(candidates: DataFrame, history: DataFrame, days: float, xs: Sequence[str], y: str,
                   key: str = "series_id", closed: str = "both") -> DataFrame:
    """Summed products (``models.product_columns``) of the history rows in
    ``[t - days, t]`` for every candidate (key, t), both ends inclusive (``closed``
    "left": without t), with the columns ``_s_...`` taken off the values.

    Whole days come from running sums per series and day: the difference of two of
    them, whatever the length of the range.  Rows themselves are read for the two
    days the range begins and ends in only."""
    names = models.product_names(xs)
    span = int(round(days * joins.DAY_MICROS))
    day = F.floor(epoch_micros("ts") / F.lit(joins.DAY_MICROS))
    shift = {c: f"_s_{c}" for c in (*xs, y)}
    means = history.groupBy(key).agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(s) for c, s in shift.items()])
    rows = history.join(means, key).select(key, epoch_micros("ts").alias("_us"), day.alias("_day"),
                                           *models.product_columns(xs, y, shift))
    per_day = rows.groupBy(key, "_day").agg(*[F.sum(c).alias(c) for c in names])
    ends = per_day.groupBy(key).agg(F.min("_day").alias("_from"), F.max("_day").alias("_to"))
    grid = ends.select(key, F.explode(F.sequence(F.col("_from") - 1, F.col("_to"))).alias("_day"))
    running = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    sums = write_table(grid.join(per_day, [key, "_day"], "left").select(
        key, "_day", *[F.coalesce(F.sum(c).over(running), F.lit(0.0)).alias(c) for c in names]), "history-days")
    us = epoch_micros("t")
    c = candidates.join(ends, key).withColumn("_first", F.floor((us - F.lit(span)) / F.lit(joins.DAY_MICROS))).withColumn(
        "_last", F.floor(us / F.lit(joins.DAY_MICROS)))

    def clamped(d):
        return F.greatest(F.col("_from") - 1, F.least(F.col("_to"), d))

    inner = F.col("_last") - 1 > F.col("_first")  # some whole day in between
    up = c.where(inner).select(key, "t", clamped(F.col("_last") - 1).alias("_day"), F.lit(1.0).alias("_sign"))
    down = c.where(inner).select(key, "t", clamped(F.col("_first")).alias("_day"), F.lit(-1.0).alias("_sign"))
    whole = up.unionByName(down).join(sums, [key, "_day"]).select(key, "t", *[(F.col("_sign") * F.col(n)).alias(n) for n in names])
    edges = c.select(key, "t", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_day")).join(rows, [key, "_day"]).where(
        (F.col("_us") >= us - F.lit(span)) & (F.col("_us") < us if closed == "left" else F.col("_us") <= us)).select(key, "t", *names)
    summed = whole.unionByName(edges).groupBy(key, "t").agg(*[F.sum(n).alias(n) for n in names])
    return summed.join(means, key)


def candidate_multimodels(features: DataFrame, windows: DataFrame, cfg: BacktestConfig, xs: Sequence[str]) -> DataFrame:
    """One refit candidate per distinct window start t on any number of features:
    (series_id, t, intercept, coef, n_fit), fitted on train and test rows in
    [t - refit_days, t] (validation rows excluded unless ``cfg.include_val``, the row
    at t unless ``cfg.closed`` is "left"); n_fit 0 without history."""
    if cfg.closed not in ("both", "left"):
        raise ValueError(f"closed: {cfg.closed}")
    cands = windows.select("series_id", F.col("window_start").alias("t")).distinct()
    parts = ("train", "val", "test") if cfg.include_val else ("train", "test")
    hist = reduce(joins.train_plus_test_history,
                  [features.where(F.col("split") == s).select("series_id", "ts", *xs, cfg.y_col) for s in parts])
    summed = range_products(cands, hist, cfg.refit_days, xs, cfg.y_col, closed=cfg.closed)
    # differences of running sums leave rounding dust where there is no row
    summed = summed.withColumn("_q0", F.round("_q0"))
    fit = models.solve_products(summed, xs, shift=[f"_s_{c}" for c in (*xs, cfg.y_col)], keep=("series_id", "t"))
    return cands.join(fit, ["series_id", "t"], "left").fillna({"n_fit": 0})


def candidate_models(features: DataFrame, windows: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Candidates on the one feature ``cfg.x_col``: (series_id, t, a, b, n_fit)."""
    fit = candidate_multimodels(features, windows, cfg, [cfg.x_col])
    return fit.select("series_id", "t", F.col("intercept").alias("a"), F.get("coef", F.lit(0)).alias("b"), "n_fit")


def window_table(features: DataFrame, cfg: BacktestConfig, dcfg: DriftConfig) -> DataFrame:
    """One row per (series, scenario, window): its (x, y) rows, drift signals
    and the refit candidate fitted at its start."""
    test = features.where(F.col("split") == "test")
    win = forecast_windows(test, cfg.window_size, cfg.step)
    train = features.where(F.col("split") == "train")
    wd = drift.window_drift(train, win, dcfg, cfg.y_col, window_keys=("scenario", "window_id"), written=True)
    rows = win.groupBy("series_id", "scenario", "window_id").agg(
        F.min("window_start").alias("t"),
        F.collect_list(F.struct(F.col(cfg.x_col).alias("x"), F.col(cfg.y_col).alias("y"))).alias("rows"))
    cand = candidate_models(features, win, cfg).select(
        "series_id", "t", F.col("a").alias("ca"), F.col("b").alias("cb"), "n_fit")
    return (rows.join(wd, ["series_id", "scenario", "window_id"], "left")
                .join(cand, ["series_id", "t"], "left"))


def _step(dcfg: DriftConfig, cfg: BacktestConfig, own: policies.OwnPolicy | None):
    eps = F.lit(MAPE_EPSILON)

    def scored(st, w):
        def ape(acc, r):
            return acc + F.abs((r["y"] - (st["a"] + st["b"] * r["x"])) / (r["y"] + eps))

        def se(acc, r):
            e = r["y"] - (st["a"] + st["b"] * r["x"])
            return acc + e * e

        n = F.size(w["rows"])
        return F.struct((F.aggregate(w["rows"], F.lit(0.0), ape) / n * 100).alias("mape"),
                        F.sqrt(F.aggregate(w["rows"], F.lit(0.0), se) / n).alias("rmse"))

    def step(st, w):
        def with_score(s):
            base = F.col("baseline_mape")
            guarded = F.when(base == 0, F.lit(MAPE_BASE_ZERO_GUARD)).otherwise(base)
            mape_drift = F.coalesce(s["mape"] / guarded >= F.lit(dcfg.mape_beta), F.lit(False))
            overall = (F.coalesce(w["psi_drift"], F.lit(False)) | F.coalesce(w["ks_drift"], F.lit(False))
                       | mape_drift)
            if own:
                window = F.struct(w["t_us"].alias("t_us"), s["mape"].alias("mape"), base.alias("baseline_mape"), overall.alias("overall_drift"))
                new, fire = own.stepped(st["own"], window)
            else:
                new, fire = st["own"], policies.decide(st["last_us"], w["t_us"], s["mape"], base, overall)
            refit = fire & (F.coalesce(w["n_fit"], F.lit(0)) > F.lit(cfg.min_history_rows))
            moves = refit if cfg.commit_on_success else fire
            if cfg.commit_on_success:
                new = F.when(fire & ~refit, st["own"]).otherwise(new)
            out = F.struct(w["window_id"].alias("window_id"), w["t_us"].alias("t_us"),
                           s["mape"].alias("mape"), s["rmse"].alias("rmse"), w["psi"].alias("psi"),
                           F.coalesce(w["ks_drifted"], F.lit(0)).alias("ks_drifted"),
                           overall.alias("overall_drift"), fire.alias("fire"), refit.alias("refit"),
                           st["model_us"].alias("model_us"))
            return F.struct(F.when(refit, w["ca"]).otherwise(st["a"]).alias("a"),
                            F.when(refit, w["cb"]).otherwise(st["b"]).alias("b"),
                            F.when(moves, w["t_us"]).otherwise(st["last_us"]).alias("last_us"),
                            F.when(refit, w["t_us"]).otherwise(st["model_us"]).alias("model_us"), new.alias("own"),
                            F.concat(st["out"], F.array(out)).alias("out"))

        # bind the window score once (transform over a one-element array acts as a let)
        return F.transform(F.array(scored(st, w)), with_score)[0]

    return step


def _rounds(m0: DataFrame, wt: DataFrame, cfg: BacktestConfig, dcfg: DriftConfig, specs: Sequence[PolicySpec],
            own: policies.OwnPolicy | None) -> list[DataFrame]:
    """The windows of every run folded, ``chunk_windows`` at a time: (run, o)."""
    elem = F.struct(
        "window_id", epoch_micros("t").alias("t_us"), "rows", "psi", "psi_drift",
        F.col("ks_num_drifted").alias("ks_drifted"), "ks_drift", "ca", "cb", "n_fit")
    keyed = (wt.withColumn("p", F.explode(policies.policy_array(specs)))
               .select("series_id", "scenario", "window_id", "p.*", elem.alias("w"))
               .withColumn("chunk", F.floor(F.col("window_id") / cfg.chunk_windows)))
    rounds = wt.agg(F.max(F.floor(F.col("window_id") / cfg.chunk_windows))).first()[0]
    rounds = 1 if rounds is None else int(rounds) + 1
    if rounds > 1:
        keyed = write_table(keyed, "fold-input", partition_by="chunk")
    state = (m0.select("series_id", "a", "b", "baseline_mape")
               .withColumn("last_us", F.lit(None).cast("bigint"))
               .withColumn("model_us", F.lit(None).cast("bigint"))
               .withColumn("own", own.initial() if own else F.lit(None).cast("boolean")))
    step = _step(dcfg, cfg, own)
    outs = []
    for c in range(rounds):
        g = (keyed.where(F.col("chunk") == c)
                  .groupBy(*RUN, *POLICY_COLS)
                  .agg(F.array_sort(F.collect_list("w")).alias("ws")))
        st = state if c == 0 else state.select(*RUN, "a", "b", "baseline_mape", "last_us", "model_us", "own")
        g = g.join(st, list(RUN) if c else ["series_id"])
        init = F.struct("a", "b", "last_us", "model_us", "own", F.expr(f"cast(array() as {OUT_T})").alias("out"))
        folded = g.select(*RUN, "baseline_mape", F.aggregate("ws", init, step).alias("s"))
        if rounds > 1:
            folded = write_table(folded, f"fold-round-{c}")
        outs.append(folded.select(*RUN, F.explode("s.out").alias("o")))
        state = folded.select(*RUN, "baseline_mape", "s.a", "s.b", "s.last_us", "s.model_us", "s.own")
    return outs


def run_backtest(features: DataFrame, cfg: BacktestConfig, dcfg: DriftConfig,
                 specs: Sequence[PolicySpec], materialize: bool = True) -> DataFrame:
    """Metrics log: one row per (series, policy, scenario, window) with
    timestamp, mape, rmse, psi, ks_drifted, overall_drift, fire, refit and
    the active model's fit time (null = initial model)."""
    policies.validate(specs)
    m0 = initial_model(features, cfg)
    wt = window_table(features, cfg, dcfg)
    built_in = [s for s in specs if s.kind not in policies.OWN]
    folds = [(built_in, None)] * bool(built_in) + [([s], policies.OWN[s.kind]) for s in specs if s.kind in policies.OWN]
    if len(folds) > 1:
        wt, m0 = write_table(wt, "window-table"), write_table(m0, "first-models")
    metrics = reduce(DataFrame.unionByName, [o for some, own in folds for o in _rounds(m0, wt, cfg, dcfg, some, own)])
    metrics = metrics.select(*RUN, "o.window_id", from_epoch_micros("o.t_us").alias("timestamp"),
                          "o.mape", "o.rmse", "o.psi", "o.ks_drifted", "o.overall_drift", "o.fire",
                          "o.refit", F.when(F.col("o.model_us").isNotNull(),
                                            from_epoch_micros("o.model_us")).alias("model_time"))
    if materialize:
        # the log is the result of an iterative job and is read by every
        # comparison downstream: write it once to the shared checkpoint folder
        metrics = write_table(metrics, "backtest")
    return metrics


def event_log(metrics: DataFrame) -> DataFrame:
    """POL-6: one row per completed retrain; the refit duration is a
    nullable column for whoever ran a timed fit."""
    return (metrics.where(F.col("refit"))
                   .select(*RUN, "timestamp", F.lit("retrain").alias("event"),
                           F.lit(None).cast("double").alias("retrain_time_seconds"),
                           F.lit("policy_trigger").alias("trigger_reason")))
