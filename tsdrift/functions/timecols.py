"""Time arithmetic on TIMESTAMP_NTZ columns that does not depend on the session
time zone (naive timestamps stay naive; no LTZ round trips)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_MICROS_PER_HOUR = 3_600_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), _c(ts))


def from_epoch_micros(micros) -> Column:
    return F.timestamp_add("MICROSECOND", _c(micros), F.expr(EPOCH))


def hour_number(ts) -> Column:
    """Whole hours since the epoch (floor), a dense integer grid key."""
    return F.floor(epoch_micros(ts) / F.lit(_MICROS_PER_HOUR)).cast("bigint")


def ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal from 'yyyy-MM-dd[ HH:mm:ss]' text."""
    return F.to_timestamp_ntz(F.lit(text))
