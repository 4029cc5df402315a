"""STM-2: retraining decisions on a stream of scored windows, in event time.

Windows of a run may arrive in any order.  Each (run, policy) keeps in Spark's state
store the time of its last trigger and a buffer of the windows the watermark has not
passed yet; when it passes them, be it with new windows or by an event-time timeout,
they leave the buffer in time order and are decided.  So files in any order give the
batch result.  A window that arrives behind the watermark is not folded: Spark drops
it and counts it in the query's progress (``late_windows``).

What a policy wants in a window does not depend on earlier triggers, so it is computed
as columns by the rules of ``operators.policies``; the state step only keeps the gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tsdrift.config import PolicySpec
from tsdrift.operators import policies

AHEAD = 1000  # microseconds: a watermark begins at the epoch, and windows there are not late
STATE_SCHEMA = "last_us long, gap_us long, stateful boolean, t_us array<long>, wants array<boolean>"


def _make_step(names: list[str]):
    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, gap, stateful, times, wants = state.get if state.exists else (None, None, False, [], [])
        if not state.hasTimedOut:
            for rows in frames:
                if len(rows):
                    first = rows.iloc[0]
                    gap, stateful = (None if pd.isna(first["gap_us"]) else int(first["gap_us"])), bool(first["stateful"])
                    times = [*times, *rows["t_us"].tolist()]
                    wants = [*wants, *rows["wants"].tolist()]
        watermark = state.getCurrentWatermarkMs() * 1000 - AHEAD
        order = np.argsort(times, kind="stable")
        due = [k for k in order.tolist() if times[k] <= watermark]
        out = []
        for k in due:
            fire = bool(wants[k])
            if fire and stateful and last is not None:
                fire = gap is not None and times[k] - last >= gap
            if fire:
                last = int(times[k])
            out.append((*key, int(times[k]), fire))
        left = [k for k in order.tolist() if times[k] > watermark]
        state.update((last, gap, stateful, [int(times[k]) for k in left], [bool(wants[k]) for k in left]))
        if left:
            state.setTimeoutTimestamp(max((int(times[left[0]]) + AHEAD) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return step


def stream_policy(scored: DataFrame, specs: list[PolicySpec], keys: tuple[str, ...] = ("series_id",),
                  delay: str = "0 seconds") -> DataFrame:
    """(keys..., policy, t_us, fire) of every window of ``scored`` (keys..., t_us, mape,
    baseline_mape, overall_drift; a stream) that the watermark, ``delay`` behind the
    latest window of all runs, has passed."""
    timed = scored.withColumn("event_time", F.timestamp_micros(F.col("t_us") + AHEAD)).withWatermark("event_time", delay)
    keyed = timed.withColumn("p", F.explode(policies.policy_array(specs))).select("*", "p.*").drop("p")
    wants, gap, stateful = policies.rule_columns("mape", "baseline_mape", "overall_drift")
    rows = keyed.select(*keys, "policy", "event_time", "t_us", wants.alias("wants"), gap.alias("gap_us"), stateful.alias("stateful"))
    names = [*keys, "policy", "t_us", "fire"]
    out = ", ".join(f"{k} string" for k in (*keys, "policy")) + ", t_us long, fire boolean"
    return rows.groupBy(*keys, "policy").applyInPandasWithState(
        _make_step(names), out, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def late_windows(query: StreamingQuery) -> int:
    """Windows (times policies) the query has seen behind the watermark and left out."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def closing_window(scored: DataFrame, keys: tuple[str, ...] = ("series_id",), days: int = 1) -> DataFrame:
    """A window of a run of its own (``_end``), ``days`` later than all of ``scored`` (a
    batch): replayed last, it moves the watermark past every real window."""
    end = scored.agg((F.max("t_us") + F.lit(days * 86_400_000_000)).alias("t_us"))
    new = {c: F.lit("_end") for c in keys} | {"t_us": F.col("t_us")}
    return end.select(*[(new[f.name] if f.name in new else F.lit(None)).cast(f.dataType).alias(f.name) for f in scored.schema.fields])
