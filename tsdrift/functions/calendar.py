"""Calendar features as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    return (F.weekday(_c(ts)) >= 5).cast("int")


def season(month) -> Column:
    """12, 1, 2 -> 0 (winter); 3-5 -> 1; 6-8 -> 2; 9-11 -> 3."""
    return F.floor((_c(month) % 12) / 3).cast("int")
