"""Exact quantiles without holding a group in one task.

``percentile`` is exact but keeps every distinct value of a group in one
aggregation buffer; a series holding a third of the rows would sit in one task.
``exact_quantiles`` finds the same order statistics in two passes over the values:

1. a mergeable quantile sketch per group (KLL, combined map-side) brackets every
   rank: each probability p needs the values at ranks floor(p (n - 1)) and
   ceil(p (n - 1)), and the sketch names two observed values around each;
2. one pass counts the values below every bracket and, per distinct value, those
   inside; the running count inside gives the value of the rank.

A bracket holds about 1 % of its group.  One with more than ``INSIDE``
distinct values is bracketed again by a sketch of its own values.  A sketch's bound
is a probability, not a promise: a rank that is not inside its bracket is looked for
again in the whole range, so the result is exact in any case.

NaN is greater than all other values, as in Spark's ordering.  The result equals
Spark's ``percentile`` (linear interpolation between the two ranks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.session import materialize

SKETCH = 4096  # entries of a sketch level; ranks are off by about 0.13 % at most
GRID = 512  # quantiles read from a sketch
MARGIN = 2  # of them, on either side of a rank
INSIDE = 1 << 20
NAN = float("nan")


def _bracket(rank: Column, n: Column, sketch: Column, low: Column, high: Column) -> list[Column]:
    """Values around the ``rank``-th of ``n`` (from 0): the sketch's, or the ends."""
    grid = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    below = F.floor((rank - 1) / n * GRID).cast("int") - MARGIN
    above = F.ceil((rank + 2) / n * GRID).cast("int") + MARGIN
    return [F.when(below <= 0, low).otherwise(F.get(grid, below)).alias("_lo"),
            F.when(above >= GRID, high).otherwise(F.get(grid, above)).alias("_hi")]


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    out: str = "q", written: bool = False) -> DataFrame:
    """(by..., ``out`` array<double>) with the exact linear-interpolated
    quantiles of ``value`` at ``probs`` per group (nulls ignored).  The values are
    written once, unless the caller says that ``df`` is read from a ``written``
    table anyway."""
    by = list(by)
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    v = v if written else materialize(v, "quantile-values")
    known = F.when(~F.isnan("_v"), F.col("_v"))
    stats = v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count(known).alias("_m"), F.min(known).alias("_min"), F.max(known).alias("_max"),
        F.kll_sketch_agg_double(known, SKETCH).alias("_sketch"))
    ranks = [f(F.lit(float(p)) * (F.col("_n") - 1)).cast("bigint") for p in probs for f in (F.floor, F.ceil)]
    wanted = stats.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), r.alias("_k")) for i, r in enumerate(ranks)])).alias("_t"))
    wanted = wanted.select(*by, "_n", "_m", "_min", "_max", "_sketch", "_t.*")
    targets = materialize(wanted.select(
        *by, "_n", "_i", "_k", "_min", "_max", (F.col("_k") >= F.col("_m")).alias("_isnan"),
        *_bracket(F.col("_k"), F.col("_m"), F.col("_sketch"), F.col("_min"), F.col("_max"))), "quantile-targets")
    found, todo = None, targets.where("not _isnan")

    def widest_of(inside: DataFrame) -> int:
        """Most distinct values in a bracket; not counted where all together are few."""
        return inside.groupBy(*by, "_i").count().agg(F.max("count")).head()[0] if inside.count() > INSIDE else 0

    while True:
        inside, below = _counted(v, by, todo)
        widest = widest_of(inside)
        while widest > INSIDE:
            todo = materialize(_narrowed(v, by, todo, below), "quantile-targets")
            inside, below = _counted(v, by, todo)
            again = widest_of(inside)
            if again >= widest:  # no sketch can cut it further
                break
            widest = again
        w = Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0))
        hit = inside.join(below, [*by, "_i"]).withColumn("_ahead", ahead).where(
            (F.col("_ahead") <= F.col("_k")) & (F.col("_k") < F.col("_ahead") + F.col("_c"))).select(*by, "_i", "_v")
        hit = materialize(hit, "quantile-values-found")
        found = hit if found is None else found.unionByName(hit)
        if hit.count() == todo.count():  # one value per rank
            break
        missed = todo.join(hit.select(*by, "_i"), [*by, "_i"], "left_anti")
        todo = materialize(missed.withColumn("_lo", F.col("_min")).withColumn("_hi", F.col("_max")), "quantile-targets")
    each = targets.join(found, [*by, "_i"], "left").select(*by, "_n", "_i", F.coalesce("_v", F.lit(NAN)).alias("_v"))
    picked = each.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_q"))

    def interp(j: int, p: float) -> Column:
        position = F.lit(float(p)) * (F.col("_n") - 1)
        xl, xh = F.col("_q")[F.lit(2 * j)], F.col("_q")[F.lit(2 * j + 1)]
        lower, higher = F.floor(position), F.ceil(position)
        return F.when((lower == higher) | (xl == xh), xl).otherwise((higher - position) * xl + (position - lower) * xh)

    return picked.select(*by, F.array(*[interp(j, p) for j, p in enumerate(probs)]).alias(out))


def _per_group(v: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """The values with their group's brackets (2 per probability at most)."""
    brackets = targets.groupBy(*by).agg(F.collect_list(F.struct("_i", "_lo", "_hi")).alias("_b"))
    return v.where(~F.isnan("_v")).join(brackets, by)


def _counted(v: DataFrame, by: list[str], targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the distinct values inside every bracket (by, _i, _v, _c), and of
    all values below it (by, _i, _k, _below).  A value is below a run of brackets
    that begins at some place of their order, so it is counted there only."""
    rows = _per_group(v, by, targets)
    inside = materialize(rows.withColumn("_t", F.explode(F.filter(
        "_b", lambda b: (b["_lo"] <= F.col("_v")) & (F.col("_v") <= b["_hi"])))).groupBy(
        *by, F.col("_t._i").alias("_i"), "_v").agg(F.count(F.lit(1)).alias("_c")), "quantile-inside")
    over = F.size(F.filter("_b", lambda b: b["_lo"] <= F.col("_v")))  # brackets that begin at or below the value
    steps = rows.groupBy(*by, over.alias("_over")).agg(F.count(F.lit(1)).alias("_c"))
    order = targets.select(*by, "_i", "_k", "_lo", F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy("_lo").rangeBetween(
                               Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
                           F.count(F.lit(1)).over(Window.partitionBy(*by, "_lo")).alias("_same"))
    # values with fewer brackets at or below them than those strictly before this one, and it
    sums = steps.groupBy(*by).agg(F.collect_list(F.struct("_over", "_c")).alias("_s"))
    least = F.col("_upto") - F.col("_same") + 1
    below = F.aggregate(F.filter("_s", lambda s: s["_over"] < least), F.lit(0).cast("bigint"), lambda a, s: a + s["_c"])
    return inside, order.join(sums, by, "left").select(*by, "_i", "_k", F.coalesce(below, F.lit(0)).alias("_below"))


def _narrowed(v: DataFrame, by: list[str], targets: DataFrame, below: DataFrame) -> DataFrame:
    """Brackets from a sketch of the values inside each bracket."""
    rows = _per_group(v, by, targets).withColumn("_t", F.explode(F.filter(
        "_b", lambda b: (b["_lo"] <= F.col("_v")) & (F.col("_v") <= b["_hi"]))))
    own = rows.groupBy(*by, F.col("_t._i").alias("_i")).agg(
        F.count(F.lit(1)).alias("_in"), F.kll_sketch_agg_double("_v", SKETCH).alias("_sketch"))
    inner = targets.join(own, [*by, "_i"]).join(below.select(*by, "_i", "_below"), [*by, "_i"])
    rank = F.col("_k") - F.col("_below")
    return inner.select(*[c for c in targets.columns if c not in ("_lo", "_hi")],
                        *_bracket(rank, F.col("_in"), F.col("_sketch"), F.col("_lo"), F.col("_hi")))
