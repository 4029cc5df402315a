"""Retraining policies on Columns (POL-0..6).

A policy decides, window by window, whether to retrain.  The built-in kinds have
one piece of state, the time of the last trigger, so a decision is a ``when`` chain
on the window's signals plus that time.

Where the signals do not depend on earlier decisions (``fire_sequence``), ``never``
and ``performance`` are plain predicates.  ``periodic`` and ``hybrid`` fire at a
window, then at the first eligible window that lies the policy's gap behind it: that
is a pointer from window to window, and the triggers are what the pointers reach
from the first eligible window.  Pointer doubling finds them in logarithmically many
joins, without gathering a run's windows in one value.  In the backtest a decision
changes later signals; there the rules are folded window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.config import POLICY_KINDS, PolicySpec
from tsdrift.session import discard, materialize

MICROS_PER_HOUR = 3_600_000_000.0
MICROS_PER_DAY = 86_400_000_000.0
POLICY_DDL = ("policy string, kind string, retrain_interval_days double, mape_threshold double, "
              "min_retrain_interval_hours double, use_drift_signals boolean")


@dataclass(frozen=True)
class OwnPolicy:
    """A user's policy: a fold step on Columns with a state of its own.

    ``state`` is the DDL of the state's fields, ``start`` their values before a run's
    first window.  ``step(state, window)`` gets the state and the window as structs
    (window: t_us, mape, baseline_mape, overall_drift) and returns the new state, a
    struct of the same fields, and whether to fire."""

    kind: str
    state: str
    start: dict
    step: Callable[[Column, Column], tuple[Column, Column]]

    def initial(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in self.start.items()]).cast(f"struct<{self._fields()}>")

    def stepped(self, state: Column, window: Column) -> tuple[Column, Column]:
        new, fire = self.step(state, window)
        return new.cast(f"struct<{self._fields()}>"), F.coalesce(fire, F.lit(False))

    def _fields(self) -> str:
        return ", ".join(f"{n}: {t}" for n, t in (x.split(None, 1) for x in self.state.split(", ")))


OWN: dict[str, OwnPolicy] = {}


def register_policy(own: OwnPolicy) -> None:
    """Make ``own`` usable as the ``kind`` of a ``PolicySpec``."""
    if own.kind in POLICY_KINDS:
        raise ValueError(f"built-in policy: {own.kind}")
    OWN[own.kind] = own


def validate(specs: Sequence[PolicySpec]) -> None:
    """Unknown policy kinds are an error before any job runs (POL-4)."""
    for s in specs:
        if s.kind not in POLICY_KINDS and s.kind not in OWN:
            raise ValueError(f"Unknown policy: {s.name} ({s.kind})")


def _spec_struct(s: PolicySpec) -> Column:
    return F.struct(
        F.lit(s.name).alias("policy"), F.lit(s.kind).alias("kind"),
        F.lit(s.retrain_interval_days).cast("double").alias("retrain_interval_days"),
        F.lit(s.mape_threshold).cast("double").alias("mape_threshold"),
        F.lit(s.min_retrain_interval_hours).cast("double").alias("min_retrain_interval_hours"),
        F.lit(s.use_drift_signals).cast("boolean").alias("use_drift_signals"))


def policy_array(specs: Sequence[PolicySpec]) -> Column:
    """Literal array of policy structs; ``explode`` it to attach every policy
    to every run key (no join)."""
    validate(specs)
    return F.array(*[_spec_struct(s) for s in specs])


def mape_ratio(mape: Column, baseline: Column) -> Column:
    """mape / baseline as floating-point division has it: infinite over a zero
    baseline, and null (no ratio) for zero over zero."""
    return F.when(baseline == 0, F.when(mape > 0, F.lit(float("inf")))).otherwise(mape / baseline)


def wants(mape: Column, baseline: Column, overall: Column) -> Column:
    """Whether the row's policy would fire if its gap since the last trigger were
    over (POL-0..3)."""
    worse = F.coalesce(mape_ratio(mape, baseline) > F.col("mape_threshold"), F.lit(False))
    use_drift = F.coalesce(F.col("use_drift_signals"), F.lit(True))
    return (F.when(F.col("kind") == "never", F.lit(False))
             .when(F.col("kind") == "periodic", F.lit(True))
             .when(F.col("kind") == "performance", baseline.isNotNull() & worse)
             .when(F.col("kind") == "hybrid", baseline.isNotNull() & (worse | (use_drift & F.coalesce(overall, F.lit(False)))))
             .otherwise(F.raise_error(F.concat(F.lit("Unknown policy: "), F.col("kind")))))


def rule_columns(mape: str, baseline: str, overall: str) -> tuple[Column, Column, Column]:
    """Of a row with policy columns: what it wants, the least microseconds between its
    triggers, and whether it has such a gap."""
    gap = F.ceil(F.when(F.col("kind") == "periodic", F.col("retrain_interval_days") * MICROS_PER_DAY)
                  .when(F.col("kind") == "hybrid", F.col("min_retrain_interval_hours") * MICROS_PER_HOUR)).cast("bigint")
    return wants(F.col(mape), F.col(baseline), F.col(overall)), gap, F.col("kind").isin("periodic", "hybrid")


def decide(last_us: Column, t_us: Column, mape: Column, baseline: Column, overall: Column) -> Column:
    """POL-0..3 fire flag for one window given the last trigger time (micros,
    null before the first), the window MAPE, the baseline MAPE and the
    window's overall drift flag.  Policy parameters are read from the row's
    policy columns."""
    elapsed = (t_us - last_us).cast("double")
    gap_over = (F.when(F.col("kind") == "periodic", elapsed / MICROS_PER_DAY >= F.col("retrain_interval_days"))
                 .when(F.col("kind") == "hybrid", elapsed / MICROS_PER_HOUR >= F.col("min_retrain_interval_hours"))
                 .otherwise(F.lit(True)))
    return wants(mape, baseline, overall) & (last_us.isNull() | F.coalesce(gap_over, F.lit(False)))


def fire_sequence(df: DataFrame, keys: Sequence[str], t: str = "t_us", mape: str = "mape",
                  baseline: str = "baseline_mape", overall: str = "overall_drift") -> DataFrame:
    """Triggers of each policy over the windows of each key when the signals do not
    depend on earlier decisions (POL-1 schedule, POL-3 guard over fixed signals).
    One row per row of ``df`` with ``fire``.  Windows of one time are taken in the
    order of (mape, overall).  Registered policies of the user's own are folded window
    by window, as nothing is known of their state; their group is the windows of one
    run (window summaries, never rows)."""
    run = [*keys, "policy"]
    own = [_folded(df.where(F.col("kind") == k), run, o, t, mape, baseline, overall) for k, o in OWN.items()]
    if own:
        df = df.where(~F.col("kind").isin(list(OWN)))
    want, gap, stateful = rule_columns(mape, baseline, overall)
    order = Window.partitionBy(*run).orderBy(t, mape, overall)
    rows = materialize(df.select(
        *run, F.col(t).alias(t), want.alias("_wants"), gap.alias("_gap"), stateful.alias("_stateful"), F.row_number().over(order).alias("_pos")), "policy-windows")
    reached = _reached(rows.where("_stateful and _wants").select(*run, F.col(t).alias("_t"), "_gap", "_pos"), run)
    hit = reached.select(*[F.col(c).alias(f"_r_{c}") for c in run], F.col("_pos").alias("_r_pos"), F.lit(True).alias("_hit"))
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in run]
    joined = rows.join(hit, [*same, F.col("_pos") == F.col("_r_pos")], "left")
    fire = F.when(F.col("_stateful"), F.coalesce("_hit", F.lit(False))).otherwise(F.col("_wants"))
    return reduce(DataFrame.unionByName, own, joined.select(*run, t, fire.alias("fire")))


def _folded(df: DataFrame, run: Sequence[str], own: OwnPolicy, t: str, mape: str, baseline: str, overall: str) -> DataFrame:
    window = F.struct(F.col(t).alias("t_us"), F.col(mape).alias("mape"), F.col(overall).alias("overall_drift"), F.col(baseline).alias("baseline_mape"))
    runs = df.groupBy(*run).agg(F.sort_array(F.collect_list(window)).alias("_w"))
    out = "array<struct<t:bigint,fire:boolean>>"
    init = F.struct(own.initial().alias("state"), F.expr(f"cast(array() as {out})").alias("out"))

    def step(st: Column, w: Column) -> Column:
        state, fire = own.stepped(st["state"], w)
        return F.struct(state.alias("state"), F.concat(st["out"], F.array(F.struct(w["t_us"].alias("t"), fire.alias("fire")))).alias("out"))

    return runs.select(*run, F.explode(F.aggregate("_w", init, step)["out"]).alias("o")).select(*run, F.col("o.t").alias(t), F.col("o.fire").alias("fire"))


def _reached(rows: DataFrame, run: Sequence[str]) -> DataFrame:
    """(run, _pos) of the windows reached from the first of each run, when each
    window points to the first later one at least ``_gap`` behind it.

    ``_next`` jumps 2^k pointers in round k, and the windows reached so far are the
    first 2^k; a round adds their targets and doubles the jumps."""
    # a marker for the time each window waits for: the first window at or after it,
    # seen as the last one before it when read backwards
    windows = rows.select(*run, "_pos", F.col("_t").alias("_at"), F.lit(0).alias("_marker"), "_gap")
    markers = rows.select(*run, "_pos", (F.col("_t") + F.greatest("_gap", F.lit(0))).alias("_at"), F.lit(1).alias("_marker"), "_gap")
    back = Window.partitionBy(*run).orderBy(F.col("_at").desc(), "_marker", F.col("_pos").desc())
    seen = F.last(F.when(F.col("_marker") == 0, F.col("_pos")), ignorenulls=True).over(
        back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pointed = windows.unionByName(markers).withColumn("_seen", seen).where("_marker = 1")
    # no gap at all: the next window of the run, whatever its time
    step = Window.partitionBy(*run).orderBy("_pos")
    after = F.lead("_pos").over(step)
    pointed = pointed.withColumn("_next", F.when(F.col("_gap") > 0, F.col("_seen")).when(F.col("_gap") <= 0, after))
    now = materialize(pointed.select(*run, "_pos", "_next", (F.row_number().over(step) == 1).alias("_hit")), "pointers")
    while True:
        targets = now.where("_hit and _next is not null").select(*[F.col(c).alias(f"_t_{c}") for c in run], F.col("_next").alias("_t_pos"))
        jumps = now.select(*[F.col(c).alias(f"_j_{c}") for c in run], F.col("_pos").alias("_j_pos"), F.col("_next").alias("_j_next"))
        if targets.isEmpty():
            return now.where("_hit").select(*run, "_pos")
        on_target = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in run] + [F.col("_pos") == F.col("_t_pos")]
        on_jump = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in run] + [F.col("_next") == F.col("_j_pos")]
        joined = now.join(targets, on_target, "left").join(jumps, on_jump, "left")
        after_round = materialize(joined.select(*run, "_pos", F.col("_j_next").alias("_next"),
                                                (F.col("_hit") | F.col("_t_pos").isNotNull()).alias("_hit")), "pointers")
        discard(now)
        now = after_round
