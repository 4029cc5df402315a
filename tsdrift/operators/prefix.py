"""Block helpers that keep ordered work off a single task.

A plain ``Window.partitionBy(series).orderBy(ts)`` puts a whole series in one
task; one hot series can hold a third of the rows.  These helpers split each
series into blocks of consecutive positions:

* ``with_halo``      rows near the end of a block are copied into the next
                     block so fixed-size frames (lags, rolling stats) can be
                     computed inside ``(series, block)`` partitions;
* ``positions``      exact 0-based row positions via per-block counts and a
                     small per-series cumulative table;
* ``fill_neighbours`` previous / next non-null value across block borders via
                     a small per-block carry table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.session import materialize

BLOCK = "_blk"
OWN = "_own"


def with_halo(df: DataFrame, pos: str, block_rows: int, halo: int) -> DataFrame:
    """Add ``_blk`` = pos div block_rows and ``_own``; the last ``halo`` rows before a
    block appear in it once more with ``_own = false``, from as many earlier blocks as
    that takes.  Drop those copies after the windowed step."""
    blk = F.floor(F.col(pos) / F.lit(block_rows))
    last = F.floor((F.col(pos) + F.lit(halo)) / F.lit(block_rows))
    return (df.withColumn("_home", blk)
              .withColumn(BLOCK, F.explode(F.sequence(blk, last)))
              .withColumn(OWN, F.col(BLOCK) == F.col("_home"))
              .drop("_home"))


def block_window(keys: Sequence[str], pos: str) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(pos)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
              out: str = "pos") -> DataFrame:
    """Exact 0-based position of each row within ``keys`` ordered by ``order``.

    ``block`` must be non-decreasing in ``order`` (for instance a coarse time
    bucket).  Work is partitioned by (keys, block); only the per-block counts
    (one row per block) are windowed per key.
    """
    d = df.withColumn(BLOCK, block)
    in_block = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order)) - 1
    d = d.withColumn("_rn", in_block)
    counts = d.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (d.join(offsets, [*keys, BLOCK])
             .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
             .drop("_off", "_rn", BLOCK))


def range_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos",
                    total: str | None = None) -> DataFrame:
    """Exact 0-based position of each row within ``keys`` (none: of the table)
    ordered by ``order``, and with ``total`` the number of rows of the key.

    The rows are range-partitioned by (keys, order) and written in that order; a
    partition holds an equal share of the rows whatever the keys or the spacing
    in time.  Only one count per partition and one start per key are gathered."""
    every = [*keys, *order]
    numbered = materialize(df.repartitionByRange(*every).sortWithinPartitions(*every)
                             .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_mid", 33)
    counts = numbered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    d = numbered.withColumn("_p", part).join(offsets, "_p").withColumn(
        "_row", F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    if keys:
        starts = d.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_total"))
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first", "_total")
        d = d.join(starts, same)
    else:
        d = d.crossJoin(counts.agg(F.sum("_c").alias("_total"))).withColumn("_first", F.lit(0))
    cols = [*df.columns, (F.col("_row") - F.col("_first")).cast("bigint").alias(out)]
    return d.select(*cols, *([F.col("_total").alias(total)] if total else []))


def fill_neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str,
                    block_rows: int) -> DataFrame:
    """Add ``_prev`` / ``_next``: struct(pos, value) of the nearest non-null
    value at or before / at or after each row, across block borders."""
    blk = F.floor(F.col(pos) / F.lit(block_rows))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    d = df.withColumn(BLOCK, blk).withColumn("_known", known)
    w = Window.partitionBy(*keys, BLOCK).orderBy(pos)
    d = (d.withColumn("_prev_in", F.last("_known", ignorenulls=True)
                      .over(w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_next_in", F.first("_known", ignorenulls=True)
                      .over(w.rowsBetween(0, Window.unboundedFollowing))))
    per_block = d.groupBy(*keys, BLOCK).agg(F.max("_known").alias("_last"),
                                            F.min("_known").alias("_first"))
    wb = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = per_block.select(
        *keys, BLOCK,
        F.last("_last", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_pc"),
        F.first("_first", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_nc"),
    )
    return (d.join(carry, [*keys, BLOCK])
             .withColumn("_prev", F.coalesce("_prev_in", "_pc"))
             .withColumn("_next", F.coalesce("_next_in", "_nc"))
             .drop("_known", "_prev_in", "_next_in", "_pc", "_nc", BLOCK))
