"""DuckDB SQL text that recomputes each registered query from the raw test
tables, used as the correctness oracle.  Fragments are CTE bodies composed
into full statements; names mirror the Spark plans in ``prepare.py`` etc.

Conventions shared with the Spark side: doubles rounded to 6 places,
calendar fields INTEGER, counts BIGINT, timestamps naive.
"""

from __future__ import annotations

from tsdrift.config import (
    HOLIDAYS, HOURLY_BACKTEST, HOURLY_DRIFT, HOURLY_SPLIT, PSI_BINS, PSI_EPSILON, SplitConfig,
)

R = 6  # decimals kept in compared doubles
GRID_SCALE = 1048576.0  # doubles are snapped to multiples of 2^-20 first


def snap(expr: str) -> str:
    return f"round(round(({expr}) * {GRID_SCALE}) / {GRID_SCALE}, {R})"
EPOCH = "TIMESTAMP '1970-01-01'"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def hour_no(col: str = "ts") -> str:
    return f"datediff('hour', {EPOCH}, {col})"


HOURLY = """hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM events GROUP BY 1, 2)"""

GRID = """rng AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1),
grid AS (
  SELECT g.series_id, g.ts, h.value
  FROM (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM rng) g
  LEFT JOIN hourly h ON h.series_id = g.series_id AND h.ts = g.ts)"""

FILLED = f"""nb AS (
  SELECT series_id, ts, value, {hour_no()} AS h,
    last_value(CASE WHEN value IS NOT NULL THEN {hour_no()} END IGNORE NULLS) OVER wp AS ph,
    last_value(value IGNORE NULLS) OVER wp AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN {hour_no()} END IGNORE NULLS) OVER wn AS nh,
    first_value(value IGNORE NULLS) OVER wn AS nv
  FROM grid
  WINDOW wp AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wn AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT series_id, ts,
    CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
         ELSE pv + (nv - pv) * (h - ph) / (nh - ph) END AS value
  FROM nb)"""

REPAIRED = """bound AS (SELECT series_id, quantile_cont(value, 0.99) * 1.5 AS upper_bound FROM filled GROUP BY 1),
repaired AS (
  SELECT f.series_id, f.ts, CASE WHEN f.value > b.upper_bound THEN b.upper_bound ELSE f.value END AS value
  FROM filled f JOIN bound b USING (series_id))"""


def holiday_sql(col: str = "ts", dates=HOLIDAYS) -> str:
    lst = ", ".join(f"DATE '{d}'" for d in dates)
    return f"CAST(CAST({col} AS DATE) IN ({lst}) AS INTEGER)"


CALENDAR_COLS = f"""CAST(hour(ts) AS INTEGER) AS hour_of_day,
    CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
    CAST(day(ts) AS INTEGER) AS day_of_month,
    CAST(month(ts) AS INTEGER) AS month,
    CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
    CAST(floor((month(ts) % 12) / 3) AS INTEGER) AS season"""

FEATURE_COLS = ("load_lag_1h", "load_lag_24h", "load_lag_168h", "load_roll_mean_24h",
                "load_roll_std_24h", "hour_of_day", "day_of_week", "day_of_month", "month",
                "is_weekend", "season", "is_holiday")

FEAT0 = f"""feat0 AS (
  SELECT series_id, ts, value AS load,
    CASE WHEN {hour_no()} - lag({hour_no()}, 1) OVER w = 1 THEN lag(value, 1) OVER w END AS load_lag_1h,
    CASE WHEN {hour_no()} - lag({hour_no()}, 24) OVER w = 24 THEN lag(value, 24) OVER w END AS load_lag_24h,
    CASE WHEN {hour_no()} - lag({hour_no()}, 168) OVER w = 168 THEN lag(value, 168) OVER w END AS load_lag_168h,
    CASE WHEN count(value) OVER r24 = 24 AND {hour_no()} - min({hour_no()}) OVER r24 = 23
         THEN avg(value) OVER r24 END AS load_roll_mean_24h,
    CASE WHEN count(value) OVER r24 = 24 AND {hour_no()} - min({hour_no()}) OVER r24 = 23
         THEN stddev_samp(value) OVER r24 END AS load_roll_std_24h,
    {CALENDAR_COLS},
    {holiday_sql()} AS is_holiday
  FROM repaired
  WINDOW w AS (PARTITION BY series_id ORDER BY ts),
         r24 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


def rule_sql(rule, col: str = "ts") -> str:
    parts = []
    if rule.months is not None:
        parts.append(f"month({col}) IN ({', '.join(str(m) for m in rule.months)})")
    if rule.year is not None:
        parts.append(f"year({col}) = {rule.year}")
    if rule.start is not None:
        parts.append(f"{col} >= TIMESTAMP '{rule.start}'")
    if rule.end is not None:
        parts.append(f"{col} <= TIMESTAMP '{rule.end}'")
    return " AND ".join(parts) or "TRUE"


def split_sql(cfg: SplitConfig, col: str = "ts") -> str:
    return (f"CASE WHEN {col} < TIMESTAMP '{cfg.val_start}' THEN 'train' "
            f"WHEN {col} < TIMESTAMP '{cfg.test_start}' THEN 'val' ELSE 'test' END")


def scenario_sql(cfg: SplitConfig, col: str = "ts") -> str:
    whens = " ".join(f"WHEN {rule_sql(r, col)} THEN '{r.name}'" for r in reversed(cfg.rules))
    inner = f"CASE {whens} ELSE '{cfg.default_scenario}' END" if cfg.rules else f"'{cfg.default_scenario}'"
    return f"CASE WHEN ({split_sql(cfg, col)}) = 'test' THEN {inner} END"


def features_cte(cfg: SplitConfig = HOURLY_SPLIT) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in ("load", *FEATURE_COLS))
    return f"""features AS (
  SELECT *, {split_sql(cfg)} AS split, {scenario_sql(cfg)} AS scenario
  FROM feat0 WHERE {complete})"""


PREP = (HOURLY, GRID, FILLED, REPAIRED, FEAT0, features_cte())


def windows_cte(size: int = HOURLY_BACKTEST.window_size, step: int = HOURLY_BACKTEST.step) -> str:
    """Test rows with 0-based position per (series, scenario) and window ids."""
    if size == step:
        wid = f"pos // {size}"
        src = "pos_rows"
    else:
        wid = "k"
        src = (f"(SELECT p.*, unnest(range(CAST(greatest(0, ceil((pos - {size - 1}) / {step})) AS BIGINT), "
               f"pos // {step} + 1)) AS k FROM pos_rows p)")
    return f"""pos_rows AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, scenario ORDER BY ts) - 1 AS pos
  FROM features WHERE split = 'test'),
win AS (
  SELECT *, CAST({wid} AS BIGINT) AS window_id,
    min(ts) OVER (PARTITION BY series_id, scenario, {wid}) AS window_start
  FROM {src})"""


def breakpoints_cte(name: str = "bp", src: str = "ref", value: str = "load", bins: int = PSI_BINS) -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""{name} AS (
  SELECT series_id, list_sort(list_distinct(quantile_cont({value}, [{probs}]))) AS bp
  FROM {src} WHERE {value} IS NOT NULL GROUP BY 1)"""


def psi_ctes(value: str = "load", eps: float = PSI_EPSILON,
             ref_where: str = "split = 'train'", cur: str = "win",
             wkeys: tuple[str, ...] = ("scenario", "window_id"), ref_src: str = "features") -> tuple[str, ...]:
    """PSI of ``cur`` ``value`` against ``ref_src`` rows (``ref_where``) per
    (series, wkeys...)."""
    wk = ", ".join(wkeys)
    wkw = ", ".join(f"w.{k}" for k in wkeys)
    on = " AND ".join(f"cc.{k} = a.{k}" for k in wkeys)
    return (
        f"ref AS (SELECT series_id, {value} AS v FROM {ref_src} WHERE {ref_where} AND {value} IS NOT NULL)",
        breakpoints_cte("bp", "ref", "v"),
        "rb AS (SELECT r.series_id, len(list_filter(b.bp, lambda x: x < r.v)) AS bin FROM ref r JOIN bp b USING (series_id))",
        "rc AS (SELECT series_id, bin, count(*) AS c FROM rb GROUP BY ALL)",
        "rn AS (SELECT series_id, count(*) AS n FROM ref GROUP BY 1)",
        f"cb AS (SELECT w.series_id, {wkw}, len(list_filter(b.bp, lambda x: x < w.{value})) AS bin "
        f"FROM {cur} w JOIN bp b USING (series_id) WHERE w.{value} IS NOT NULL)",
        f"cc AS (SELECT series_id, {wk}, bin, count(*) AS c FROM cb GROUP BY ALL)",
        f"cn AS (SELECT series_id, {wk}, count(*) AS n FROM cb GROUP BY ALL)",
        f"""allbins AS (SELECT k.series_id, {', '.join(f'k.{x}' for x in wkeys)}, k.n, unnest(range(0, len(b.bp) + 1)) AS bin,
            len(b.bp) + 1 AS n_bins FROM cn k JOIN bp b USING (series_id))""",
        f"""psi_t AS (
  SELECT a.series_id, {', '.join(f'a.{x}' for x in wkeys)}, a.n_bins,
    sum((coalesce(cc.c, 0) / a.n + {eps} - (coalesce(rc.c, 0) / rn.n + {eps}))
        * ln((coalesce(cc.c, 0) / a.n + {eps}) / (coalesce(rc.c, 0) / rn.n + {eps}))) AS psi
  FROM allbins a
  JOIN rn ON rn.series_id = a.series_id
  LEFT JOIN cc ON cc.series_id = a.series_id AND {on} AND cc.bin = a.bin
  LEFT JOIN rc ON rc.series_id = a.series_id AND rc.bin = a.bin
  GROUP BY ALL)""",
    )


def psi_severity_sql(col: str = "psi") -> str:
    return f"CASE WHEN {col} < 0.1 THEN 'stable' WHEN {col} < 0.25 THEN 'warning' ELSE 'critical' END"


def psi_drift_sql(col: str = "psi", threshold: float = HOURLY_DRIFT.psi_threshold) -> str:
    return f"({psi_severity_sql(col)} = 'critical' OR {col} >= {threshold})"


# ---------------------------------------------------------------- KS
def _unpivot(src: str, keys: str, feats, where: str = "TRUE") -> str:
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in feats)
    on = ", ".join(feats)
    return (f"(UNPIVOT (SELECT {keys}, {casts} FROM {src} WHERE {where}) "
            f"ON {on} INTO NAME feature VALUE value)")


def ks_ctes(feats=HOURLY_DRIFT.features, ref_where: str = "split = 'train'", cur: str = "win",
            wkeys: tuple[str, ...] = ("scenario", "window_id"), alpha: float = HOURLY_DRIFT.ks_alpha,
            ref_src: str = "features", running: bool = False) -> tuple[str, ...]:
    """KS statistic per (series, feature, wkeys...) of ``cur`` values against
    reference values; ``running``: by running sums instead of a join of all values,
    for long series."""
    wk = ", ".join(wkeys)
    part = f"series_id, {wk}, feature"
    return (
        f"kref AS (SELECT * FROM {_unpivot(ref_src, 'series_id', feats, ref_where)} WHERE value IS NOT NULL)",
        f"kcur AS (SELECT * FROM {_unpivot(cur, 'series_id, ' + wk, feats)} WHERE value IS NOT NULL)",
        "knref AS (SELECT series_id, feature, count(*) AS n_ref FROM kref GROUP BY ALL)",
        f"""kcv AS (
  SELECT DISTINCT series_id, {wk}, feature, value,
    count(*) OVER (PARTITION BY {part} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_le,
    count(*) OVER (PARTITION BY {part}, value) AS c_eq,
    count(*) OVER (PARTITION BY {part}) AS n_cur
  FROM kcur)""",
        *([f"""kall AS (
  SELECT series_id, feature, value, 1 AS r FROM kref UNION ALL SELECT DISTINCT series_id, feature, value, 0 AS r FROM kcur)""",
           """kcum AS (
  SELECT DISTINCT series_id, feature, value, r_le, r_le - r_eq AS r_lt FROM (
    SELECT *, sum(r) OVER (PARTITION BY series_id, feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r_le,
      sum(r) OVER (PARTITION BY series_id, feature, value) AS r_eq FROM kall))""",
           """kgap AS (
  SELECT c.*, n.n_ref, m.r_le, m.r_lt FROM kcv c JOIN knref n USING (series_id, feature) JOIN kcum m USING (series_id, feature, value))"""]
          if running else [f"""kgap AS (
  SELECT c.series_id, {', '.join(f'c.{k}' for k in wkeys)}, c.feature, c.value, c.c_le, c.c_eq, c.n_cur, n.n_ref,
    count_if(r.value <= c.value) AS r_le, count_if(r.value < c.value) AS r_lt
  FROM kcv c JOIN knref n USING (series_id, feature)
  LEFT JOIN kref r ON r.series_id = c.series_id AND r.feature = c.feature
  GROUP BY ALL)"""]),
        f"""ks_t AS (
  SELECT series_id, {wk}, feature, n_ref, n_cur,
    max(greatest(abs(r_le / n_ref - c_le / n_cur), abs(r_lt / n_ref - (c_le - c_eq) / n_cur))) AS ks_statistic
  FROM kgap GROUP BY ALL)""",
        f"""ks_p AS (SELECT *, {kolmogorov_sql('ks_statistic', 'n_ref', 'n_cur')} AS p_value FROM ks_t)""",
        f"""ks_v AS (
  SELECT series_id, {wk},
    string_agg(CASE WHEN p_value < {alpha} THEN feature END, ',' ORDER BY {feature_order_sql(feats)}) AS drifted_features,
    CAST(count_if(p_value < {alpha}) AS INTEGER) AS ks_num_drifted
  FROM ks_p GROUP BY ALL)""",
    )


def feature_order_sql(feats) -> str:
    whens = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(feats))
    return f"CASE feature {whens} END"


def kolmogorov_sql(d: str, n: str, m: str) -> str:
    lam = f"(sqrt({n} * {m} / ({n} + {m})) * {d})"
    series = (f"2.0 * list_reduce(list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) * "
              f"exp(-2.0 * k * k * {lam} * {lam})), lambda a, b: a + b)")
    return f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, {series})) END"


# ---------------------------------------------------------------- models and backtest
def model_ctes(bt=HOURLY_BACKTEST) -> tuple[str, ...]:
    x, y = bt.x_col, bt.y_col
    span = int(round(bt.refit_days * 86_400_000_000))
    fit = (f"coalesce(nullif(regr_intercept({y}, {x}), 'NaN'::DOUBLE), avg({y})) AS a, "
           f"coalesce(nullif(regr_slope({y}, {x}), 'NaN'::DOUBLE), 0.0) AS b, count({y}) AS n_fit")
    return (
        f"m0 AS (SELECT series_id, {fit} FROM features WHERE split = 'train' GROUP BY 1)",
        f"""base AS (
  SELECT f.series_id, avg(abs((f.{y} - (m.a + m.b * f.{x})) / (f.{y} + 1e-08))) * 100 AS baseline_mape
  FROM features f JOIN m0 m USING (series_id) WHERE f.split = 'val' GROUP BY 1)""",
        "cand AS (SELECT DISTINCT series_id, window_start AS t FROM win)",
        f"""cfit AS (
  SELECT c.series_id, c.t, {fit.replace(f'({y}', f'(h.{y}').replace(f', {x})', f', h.{x})')}
  FROM cand c JOIN features h ON h.series_id = c.series_id AND h.split IN ('train', 'test')
    AND h.ts >= c.t - to_microseconds({span}) AND h.ts <= c.t
  GROUP BY ALL)""",
        """models AS (
  SELECT series_id, CAST(NULL AS TIMESTAMP) AS mt, a, b FROM m0
  UNION ALL SELECT series_id, t, a, b FROM cfit)""",
        f"""pairs AS (
  SELECT w.series_id, w.scenario, w.window_id, m.mt,
    sum(abs((w.{y} - (m.a + m.b * w.{x})) / (w.{y} + 1e-08))) / count(*) * 100 AS mape,
    sqrt(sum((w.{y} - (m.a + m.b * w.{x})) * (w.{y} - (m.a + m.b * w.{x}))) / count(*)) AS rmse
  FROM win w JOIN models m ON m.series_id = w.series_id AND (m.mt IS NULL OR m.mt < w.window_start)
  GROUP BY ALL)""",
    )


def multilinear_ctes(name: str, src: str, xs, keys: str = "series_id", y: str = "load") -> tuple[str, ...]:
    """Least squares of ``y`` on ``xs`` per ``keys``: centred cross products, column
    by column elimination, no coefficient for columns without a pivot."""
    p, m = len(xs), len(xs) + 1
    cols = [f"CAST({c} AS DOUBLE)" for c in (*xs, y)]
    cells = ", ".join(f"sum((c{i} - a{i}) * (c{j} - a{j}))" for i in range(p) for j in range(m))
    squares = ", ".join(f"sum(c{i} * c{i})" for i in range(p))
    flat = ", ".join(f"{c} AS c{i}" for i, c in enumerate(cols))
    cell = (f"CASE WHEN c // {m} = k THEN a[k * {m} + c % {m} + 1] / a[k * {m} + k + 1] "
            f"ELSE a[c + 1] - a[(c // {m}) * {m} + k + 1] * a[k * {m} + c % {m} + 1] / a[k * {m} + k + 1] END")
    usable = f"(spread[k + 1] > 0 AND a[k * {m} + k + 1] > 1e-10 * spread[k + 1])"
    return (
        f"{name}_r AS (SELECT {keys}, {flat} FROM {src} s_)",
        f"{name}_a AS (SELECT {keys}, count(*) AS n, {', '.join(f'avg(c{i}) AS a{i}' for i in range(m))} FROM {name}_r GROUP BY ALL)",
        f"""{name}_q AS (SELECT {keys}, any_value(n) AS n, [{', '.join(f'any_value(a{i})' for i in range(m))}] AS mean,
  [{cells}] AS a, [{squares}] AS sq FROM {name}_r JOIN {name}_a USING ({keys}) GROUP BY {keys})""",
        f"""{name}_s AS (SELECT {keys}, n, mean, a, 0 AS k, []::BOOLEAN[] AS used,
    list_transform(range(0, {p}), lambda i: CASE WHEN a[i * {m} + i + 1] > 1e-10 * sq[i + 1] THEN a[i * {m} + i + 1] ELSE 0.0 END) AS spread
  FROM {name}_q
  UNION ALL SELECT {keys}, n, mean,
    CASE WHEN {usable} THEN list_transform(range(0, {p * m}), lambda c: {cell}) ELSE a END, k + 1,
    list_append(used, {usable}), spread FROM {name}_s WHERE k < {p})""",
        f"""{name}_c AS (SELECT {keys}, n, mean,
    list_transform(range(0, {p}), lambda i: CASE WHEN used[i + 1] THEN a[i * {m} + {p} + 1] ELSE 0.0 END) AS coef
  FROM {name}_s WHERE k = {p})""",
        f"""{name} AS (SELECT {keys}, mean[{m}] - list_sum(list_transform(range(0, {p}), lambda i: coef[i + 1] * mean[i + 1])) AS intercept,
  coef, n AS n_fit FROM {name}_c)""",
    )


def policies_cte(specs) -> str:
    def lit(v):
        return "NULL" if v is None else (("TRUE" if v else "FALSE") if isinstance(v, bool) else repr(float(v)))
    rows = ", ".join(
        f"('{s.name}', '{s.kind}', {lit(s.retrain_interval_days)}, {lit(s.mape_threshold)}, "
        f"{lit(s.min_retrain_interval_hours)}, {lit(s.use_drift_signals)})" for s in specs)
    return (f"pol AS (SELECT * FROM (VALUES {rows}) t(policy, kind, retrain_interval_days, mape_threshold, "
            "min_retrain_interval_hours, use_drift_signals))")


def fire_sql(last: str, t: str, mape: str, base: str, overall: str) -> str:
    elapsed = f"CAST(datediff('microsecond', {last}, {t}) AS DOUBLE)"
    ratio = f"({mape} / {base})"
    return f"""(CASE p.kind
      WHEN 'never' THEN FALSE
      WHEN 'periodic' THEN ({last} IS NULL OR {elapsed} / 86400000000.0 >= p.retrain_interval_days)
      WHEN 'performance' THEN ({base} IS NOT NULL AND coalesce({ratio} > p.mape_threshold, FALSE))
      WHEN 'hybrid' THEN ({base} IS NOT NULL AND ({last} IS NULL OR {elapsed} / 3600000000.0 >= p.min_retrain_interval_hours)
                          AND (coalesce({ratio} > p.mape_threshold, FALSE) OR (coalesce(p.use_drift_signals, TRUE) AND {overall})))
    END)"""


def backtest_ctes(specs, dcfg=HOURLY_DRIFT, bt=HOURLY_BACKTEST) -> tuple[str, ...]:
    """Window signals + the closed-loop fold as a recursive CTE."""
    overall = (f"(coalesce(s.psi_drift, FALSE) OR coalesce(s.ks_num_drifted >= {dcfg.ks_drift_count}, FALSE) "
               f"OR coalesce(pr.mape / (CASE WHEN s.baseline_mape = 0 THEN 1e-10 ELSE s.baseline_mape END) "
               f">= {dcfg.mape_beta}, FALSE))")
    cols = """s.series_id, p.policy, s.scenario, s.window_id, s.window_start, pr.mape, pr.rmse, s.psi,
      coalesce(s.ks_num_drifted, 0) AS ks_drifted"""
    return (
        policies_cte(specs),
        f"""wstat AS (
  SELECT w.series_id, w.scenario, w.window_id, w.window_start, ps.psi, {psi_drift_sql('ps.psi', dcfg.psi_threshold)} AS psi_drift,
    kv.ks_num_drifted, coalesce(cf.n_fit, 0) AS n_fit, b.baseline_mape
  FROM (SELECT DISTINCT series_id, scenario, window_id, window_start FROM win) w
  JOIN psi_t ps USING (series_id, scenario, window_id)
  LEFT JOIN ks_v kv USING (series_id, scenario, window_id)
  LEFT JOIN cfit cf ON cf.series_id = w.series_id AND cf.t = w.window_start
  LEFT JOIN base b ON b.series_id = w.series_id)""",
        _fold_sql(cols, overall, bt),
        _fold_sql(cols, overall, bt, static=True, name="sfold"),
    )


def _fold_sql(cols: str, overall: str, bt, static: bool = False, name: str = "fold") -> str:
    def step(last: str, model: str) -> str:
        fire = fire_sql(last, "s.window_start", "pr.mape", "s.baseline_mape", overall)
        refit = "FALSE" if static else f"({fire} AND s.n_fit > {bt.min_history_rows})"
        return f"""{cols}, {model} AS model_time, {overall} AS overall_drift,
    {fire} AS fire, {refit} AS refit,
    CASE WHEN {refit} THEN s.window_start ELSE {model} END AS next_model,
    CASE WHEN {fire} THEN s.window_start ELSE {last} END AS next_last"""

    return f"""{name} AS (
  SELECT {step('CAST(NULL AS TIMESTAMP)', 'CAST(NULL AS TIMESTAMP)')}
  FROM wstat s JOIN pol p ON TRUE
  JOIN pairs pr ON pr.series_id = s.series_id AND pr.scenario = s.scenario AND pr.window_id = s.window_id AND pr.mt IS NULL
  WHERE s.window_id = 0
  UNION ALL
  SELECT {step('f.next_last', 'f.next_model')}
  FROM {name} f
  JOIN wstat s ON s.series_id = f.series_id AND s.scenario = f.scenario AND s.window_id = f.window_id + 1
  JOIN pol p ON p.policy = f.policy
  JOIN pairs pr ON pr.series_id = s.series_id AND pr.scenario = s.scenario AND pr.window_id = s.window_id
    AND pr.mt IS NOT DISTINCT FROM f.next_model)"""


# ---------------------------------------------------------------- evaluation
def normal_sf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {x}))"
    poly = "0.17087277"
    for coef in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806,
                 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({coef} + {t} * {poly})"
    upper = f"(0.5 * ({t} * exp(-{x} * {x} + {poly})))"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1.0 - {upper} END)"


MET = """met AS (
  SELECT series_id, policy, scenario, window_id, window_start AS timestamp, mape, rmse, psi, ks_drifted, refit
  FROM fold)"""
EVENTS = """ev AS (SELECT series_id, policy, scenario, window_start AS timestamp FROM fold WHERE refit)"""
SUMM = """summ AS (
  SELECT series_id, policy, scenario, avg(mape) AS mean_mape, quantile_cont(mape, 0.5) AS median_mape,
    stddev_samp(mape) AS std_mape, arg_max(mape, window_id) AS final_mape,
    count_if(refit) AS num_retrains, 0.0 AS total_retrain_time_seconds
  FROM met GROUP BY ALL)"""


def pairs_cte(a: str = "policy3", others=("policy0", "policy1")) -> str:
    lst = ", ".join(f"'{o}'" for o in others)
    return f"""pr AS (
  SELECT x.series_id, x.scenario, y.policy AS other_policy, x.window_id, x.mape AS a, y.mape AS b
  FROM met x JOIN met y ON x.series_id = y.series_id AND x.scenario = y.scenario AND x.window_id = y.window_id
  WHERE x.policy = '{a}' AND y.policy IN ({lst}))"""


K3 = "series_id, scenario, other_policy"
WILCOXON = (
    f"wd AS (SELECT *, a - b AS d, abs(a - b) AS ad FROM pr WHERE a - b <> 0)",
    f"""wr AS (
  SELECT *, rank() OVER (PARTITION BY {K3} ORDER BY ad) + (count(*) OVER (PARTITION BY {K3}, ad) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY {K3}, ad) AS t
  FROM wd)""",
    f"""wg AS (
  SELECT {K3}, count(*) AS n, coalesce(sum(CASE WHEN d > 0 THEN r END), 0.0) AS wp,
    coalesce(sum(CASE WHEN d < 0 THEN r END), 0.0) AS wm, sum(t * t - 1) AS tie, max(t) AS max_tie
  FROM wr GROUP BY ALL)""",
    """wx AS (
  SELECT *, least(wp, wm) AS stat,
    (SELECT count(*) FROM range(0, CAST(pow(2, n) AS BIGINT)) m(m)
     WHERE list_sum(list_transform(range(0, n), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END))
           <= least(wp, wm)) AS below
  FROM wg)""",
    f"""wil AS (
  SELECT p.series_id, p.scenario, p.other_policy, coalesce(x.n, 0) AS n_nonzero, coalesce(x.stat, 0.0) AS statistic,
    coalesce(least(1.0, CASE WHEN x.n <= 50 AND x.max_tie = 1 THEN 2.0 * x.below / pow(2.0, x.n)
      ELSE 2.0 * {normal_sf_sql('abs((x.stat - x.n * (x.n + 1) / 4.0) / sqrt((x.n * (x.n + 1) * (2 * x.n + 1) - 0.5 * x.tie) / 24.0))')} END), 1.0) AS p_value
  FROM (SELECT DISTINCT {K3} FROM pr) p LEFT JOIN wx x USING ({K3}))""",
    f"""cd AS (
  SELECT {K3}, CASE WHEN sqrt((var_pop(a) + var_pop(b)) / 2) > 0
    THEN (avg(a) - avg(b)) / sqrt((var_pop(a) + var_pop(b)) / 2) ELSE 0.0 END AS cohens_d
  FROM pr GROUP BY ALL)""",
)


def bootstrap_ctes(name: str, src: str, keys: str, reps: int, seed: str = "tsdrift", conf: float = 0.95) -> tuple[str, ...]:
    """Resampled-mean interval of ``src`` (keys..., window_id, v)."""
    lo, hi = (1 - conf) / 2, (1 + conf) / 2
    return (
        f"{name}_n AS (SELECT {keys}, count(*) AS n, avg(v) AS mean FROM {src} GROUP BY ALL)",
        f"""{name}_d AS (
  SELECT {keys}, rep, n, unnest(range(0, n)) AS i FROM {name}_n, range(0, {reps}) r(rep))""",
        f"""{name}_m AS (
  SELECT d.{keys.replace(', ', ', d.')}, d.rep, avg(s.v) AS m
  FROM {name}_d d JOIN {src} s ON {' AND '.join(f's.{k} = d.{k}' for k in keys.split(', '))}
    AND s.window_id = (('0x' || substr(md5(concat_ws('-', '{seed}', d.rep, d.i)), 1, 8))::BIGINT % d.n)
  GROUP BY ALL)""",
        f"""{name} AS (
  SELECT n.{keys.replace(', ', ', n.')}, n.mean, quantile_cont(m.m, {lo}) AS ci_lower, quantile_cont(m.m, {hi}) AS ci_upper
  FROM {name}_n n JOIN {name}_m m USING ({keys}) GROUP BY ALL)""",
    )


# ---------------------------------------------------------------- daily orders fixture
from tsdrift.config import DAILY_SPLIT, HOLIDAY_MONTH_DAYS  # noqa: E402

DAILY = """daily AS (
  SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""
_MD = ", ".join(f"({m}, {d})" for m, d in HOLIDAY_MONTH_DAYS)
DAILY_FEAT = f"""dhol AS (
  SELECT make_date(CAST(y AS BIGINT), m, d) AS hd
  FROM (SELECT DISTINCT year(ts) AS y FROM daily) yy, (VALUES {_MD}) md(m, d)),
dfeat AS (
  SELECT series_id, ts, value, {CALENDAR_COLS},
    CAST(CAST(ts AS DATE) IN (SELECT hd FROM dhol) AS INTEGER) AS is_holiday,
    {split_sql(DAILY_SPLIT)} AS split, {scenario_sql(DAILY_SPLIT)} AS scenario
  FROM daily)"""
