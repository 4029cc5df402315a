"""Typed configuration: scenario rules, drift settings, policies, backtest.

The reference keeps these in YAML files; here they are frozen dataclasses so a
plan can be built from them without any file parsing.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values that must equal the studied workflow for equal results.
# ---------------------------------------------------------------------------
NULL_TOKENS = ("?", "nan", "")
READING_TS_FORMAT = "dd/MM/yyyy HH:mm:ss"
FEATURE_ORDER = (
    "load_lag_1h", "load_lag_24h", "load_lag_168h",
    "load_roll_mean_24h", "load_roll_std_24h",
    "hour_of_day", "day_of_week", "day_of_month", "month",
    "is_weekend", "season", "is_holiday",
)
LAG_HOURS = (1, 24, 168)
ROLL_HOURS = 24
# Public holidays of the studied series (2007-2010).
HOLIDAYS = (
    "2007-01-01", "2007-05-01", "2007-07-14", "2007-12-25",
    "2008-01-01", "2008-05-01", "2008-07-14", "2008-12-25",
    "2009-01-01", "2009-05-01", "2009-07-14", "2009-12-25",
    "2010-01-01", "2010-05-01", "2010-07-14", "2010-12-25",
)
# Month/day of each yearly holiday above; used to build a holiday table for
# other year ranges by rule.
HOLIDAY_MONTH_DAYS = ((1, 1), (5, 1), (7, 14), (12, 25))
MONITORED_FEATURES = ("load_lag_24h", "load_lag_168h", "hour_of_day", "load_roll_mean_24h")
PSI_BINS = 10
PSI_EPSILON = 1e-10
PSI_STABLE_BELOW = 0.1
PSI_WARNING_BELOW = 0.25
KS_ALPHA = 0.05
MAPE_EPSILON = 1e-8          # added (signed) to y in the MAPE denominator
MAPE_BASE_ZERO_GUARD = 1e-10  # a zero baseline MAPE is replaced by this
OUTLIER_QUANTILE = 0.99
OUTLIER_FACTOR = 1.5
MIN_REFIT_ROWS = 100          # refit only with more history rows than this
QUALITY_MAPE_BELOW = 5.0
QUALITY_R2_ABOVE = 0.9
SMOOTH_WINDOW = 168
DRIFT_SIGNAL_THRESHOLDS = {"psi": 0.25, "ks_drifted": 3.0}
BOOTSTRAP_REPS = 10000
BOOTSTRAP_CONF = 0.95
WILCOXON_ALPHA = 0.05
WILCOXON_EXACT_MAX_N = 50
GBT_DEFAULTS = dict(n_estimators=250, max_depth=6, learning_rate=0.05, subsample=0.8,
                    colsample_bytree=0.8, seed=42)
TUNING_SPACE = {
    "n_estimators": (200, 400, 600),
    "max_depth": (4, 6, 8, 10),
    "learning_rate": (0.01, 0.05, 0.1),
    "subsample": (0.7, 0.8, 0.9),
    "colsample_bytree": (0.7, 0.8, 0.9),
}
TUNING_ITERATIONS = 15
TUNING_FOLDS = 3
POLICY_NAMES = ("policy0", "policy1", "policy2", "policy3")


@dataclass(frozen=True)
class ScenarioRule:
    """One labelling rule.  Either a month set within a year, or a time range
    whose ends are inclusive instants (``end='2009-12-31'`` means midnight)."""

    name: str
    months: tuple[int, ...] | None = None
    year: int | None = None
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class SplitConfig:
    val_start: str
    test_start: str
    rules: tuple[ScenarioRule, ...] = ()
    default_scenario: str = "baseline"


@dataclass(frozen=True)
class DriftConfig:
    features: tuple[str, ...] = MONITORED_FEATURES
    psi_threshold: float = 0.25
    ks_drift_count: int = 3
    mape_alpha: float = 1.15
    mape_beta: float = 1.30
    bins: int = PSI_BINS
    epsilon: float = PSI_EPSILON
    ks_alpha: float = KS_ALPHA


@dataclass(frozen=True)
class PolicySpec:
    name: str
    kind: str  # never | periodic | performance | hybrid
    retrain_interval_days: float | None = None
    mape_threshold: float | None = None
    min_retrain_interval_hours: float | None = None
    use_drift_signals: bool | None = None


@dataclass(frozen=True)
class BacktestConfig:
    window_size: int
    step: int
    refit_days: float
    x_col: str = "load_lag_24h"
    y_col: str = "load"
    min_history_rows: int = MIN_REFIT_ROWS
    chunk_windows: int = 32  # windows folded per round (bounds one fold group)
    include_val: bool = False  # validation rows are refit history, too
    closed: str = "both"  # "left": a refit does not see the first row of its window
    commit_on_success: bool = False  # a policy's state moves only if the refit is done


POLICY_KINDS = ("never", "periodic", "performance", "hybrid")

# ---------------------------------------------------------------------------
# Fixed values that must equal the studied workflow for equal results, as typed
# settings.
# ---------------------------------------------------------------------------
# The four published policies.
REFERENCE_POLICIES = (
    PolicySpec("policy0", "never"),
    PolicySpec("policy1", "periodic", retrain_interval_days=7),
    PolicySpec("policy2", "performance", mape_threshold=1.30),
    PolicySpec("policy3", "hybrid", mape_threshold=1.30, min_retrain_interval_hours=168,
               use_drift_signals=True),
)

# Published split and scenario rules (last match wins).
REFERENCE_SPLIT = SplitConfig(
    val_start="2009-01-01",
    test_start="2009-07-01",
    rules=(
        ScenarioRule("seasonal_drift_winter", months=(1, 2), year=2010),
        ScenarioRule("seasonal_drift_summer", months=(7, 8), year=2010),
        ScenarioRule("holiday_drift", start="2009-12-20", end="2009-12-31"),
        ScenarioRule("long_term_drift", start="2010-09-01"),
    ),
)
REFERENCE_BACKTEST = BacktestConfig(window_size=168, step=168, refit_days=60)

# ---------------------------------------------------------------------------
# Scaled-down settings for the hourly event fixture (30 days of hours).
# ---------------------------------------------------------------------------
HOURLY_SPLIT = SplitConfig(
    val_start="2024-01-16",
    test_start="2024-01-21",
    rules=(
        ScenarioRule("holiday_drift", start="2024-01-24", end="2024-01-25"),
        ScenarioRule("long_term_drift", start="2024-01-28"),
    ),
)
HOURLY_POLICIES = (
    PolicySpec("policy0", "never"),
    PolicySpec("policy1", "periodic", retrain_interval_days=2),
    PolicySpec("policy2", "performance", mape_threshold=1.30),
    PolicySpec("policy3", "hybrid", mape_threshold=1.30, min_retrain_interval_hours=48,
               use_drift_signals=True),
)
HOURLY_BACKTEST = BacktestConfig(window_size=24, step=24, refit_days=5)
HOURLY_DRIFT = DriftConfig()

# Daily order fixture: the published rule shapes moved into 1999-2000.
DAILY_SPLIT = SplitConfig(
    val_start="1999-01-01",
    test_start="1999-07-01",
    rules=(
        ScenarioRule("seasonal_drift_winter", months=(1, 2), year=2000),
        ScenarioRule("seasonal_drift_summer", months=(7, 8), year=2000),
        ScenarioRule("holiday_drift", start="1999-12-20", end="1999-12-31"),
        ScenarioRule("long_term_drift", start="2000-09-01"),
    ),
)

