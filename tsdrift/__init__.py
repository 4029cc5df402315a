"""tsdrift: time-series drift monitoring and retraining backtests on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function keyed by
``series_id`` so the same plan serves one long series or millions of short
ones.  See README.md for the operator map.
"""

__version__ = "0.1.0"
