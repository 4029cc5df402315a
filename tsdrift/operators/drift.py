"""Distribution drift (DRF-1..10).

PSI bins the current sample by reference quantile breakpoints and compares
bin shares.  KS compares empirical CDFs; the reference CDF is looked up at
the current values only, so the reference sample is never copied per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.config import MAPE_BASE_ZERO_GUARD, PSI_BINS, PSI_EPSILON, DriftConfig
from tsdrift.functions.stats import kolmogorov_pvalue, mape_severity, psi_severity
from tsdrift.operators.quantiles import exact_quantiles
from tsdrift.session import materialize

KEY = ("series_id",)
VALUES_PER_BUCKET = 1 << 17  # distinct reference values that one task counts through


def quantile_breakpoints(ref: DataFrame, value: str = "value", by: Sequence[str] = KEY,
                         bins: int = PSI_BINS, approx: bool = False, written: bool = False) -> DataFrame:
    """DRF-1: ``bp`` = sorted distinct linear-interpolated percentiles at
    0, 1/bins, ..., 1 of the non-null reference values.

    Exact by a sketch's brackets and one counting pass (``operators.quantiles``: no
    group is held in one task); ``approx=True`` uses the mergeable quantile sketch
    alone.  ``written`` says that ``ref`` is read from a written table."""
    probs = [i / bins for i in range(bins + 1)]
    if approx:
        q = F.percentile_approx(value, F.array(*[F.lit(p) for p in probs]), 100000)
        return (ref.where(F.col(value).isNotNull()).groupBy(*by)
                   .agg(F.array_sort(F.array_distinct(q.cast("array<double>"))).alias("bp")))
    qs = exact_quantiles(ref, by, value, probs, written=written)
    return qs.select(*by, F.array_sort(F.array_distinct("q")).alias("bp"))


def assign_bins(df: DataFrame, bp: DataFrame, value: str = "value", by: Sequence[str] = KEY) -> DataFrame:
    """DRF-2: ``bin`` = number of breakpoints strictly below the value (the
    reference minimum is alone in bin 0; values above the maximum land in the
    overflow bin len(bp)); null for a series without breakpoints."""
    return (df.join(bp, list(by), "left")
              .withColumn("bin", F.size(F.filter("bp", lambda b: b < F.col(value))))
              .drop("bp"))


def _bin_shares(binned: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "_c"))).alias(f"{prefix}map"),
        F.sum("_c").alias(f"{prefix}n"))


def psi(ref: DataFrame, cur: DataFrame, value: str = "value", by: Sequence[str] = KEY,
        window_keys: Sequence[str] = ("window_id",), bins: int = PSI_BINS,
        epsilon: float = PSI_EPSILON, bp: DataFrame | None = None, written: bool = False) -> DataFrame:
    """DRF-3: one row per (by, window_keys) with ``psi`` and ``n_bins``.

    PSI = sum over bins 0..len(bp) of (c - r) * ln(c / r) with c, r the bin
    shares plus epsilon.  The overflow bin is always included, so a current
    value above the reference maximum is counted instead of failing.  A series
    without reference keeps its rows: null scores, ``psi_status``
    'no_reference'."""
    ref = ref.where(F.col(value).isNotNull())
    cur = cur.where(F.col(value).isNotNull())
    bp = bp if bp is not None else quantile_breakpoints(ref, value, by, bins, written=written)
    rs = _bin_shares(assign_bins(ref, bp, value, by), by, "r")
    cs = _bin_shares(assign_bins(cur, bp, value, by).withColumn("bin", F.coalesce("bin", F.lit(-1))),
                     [*by, *window_keys], "c")
    sizes = bp.select(*by, F.size("bp").alias("_nbp"))
    j = cs.join(rs, list(by), "left").join(sizes, list(by), "left")
    eps = F.lit(epsilon)

    def term(acc, b):
        r = F.coalesce(F.col("rmap")[b], F.lit(0)) / F.col("rn") + eps
        c = F.coalesce(F.col("cmap")[b], F.lit(0)) / F.col("cn") + eps
        return acc + (c - r) * F.ln(c / r)

    value_psi = F.aggregate(F.sequence(F.lit(0), F.col("_nbp")), F.lit(0.0), term)
    value_psi = F.when(F.col("_nbp").isNotNull() & F.col("rn").isNotNull(), value_psi)
    return j.select(*by, *window_keys, value_psi.alias("psi"), (F.col("_nbp") + 1).alias("n_bins"),
                    F.when(value_psi.isNotNull(), "ok").otherwise("no_reference").alias("psi_status"))


def psi_check(df: DataFrame, threshold: float = 0.25, col: str = "psi") -> DataFrame:
    """DRF-4: severity (< 0.1 stable, < 0.25 warning, else critical) and drift
    flag (critical, or at / above the threshold)."""
    sev = psi_severity(col)
    return (df.withColumn("psi_severity", sev)
              .withColumn("psi_drift", (sev == "critical") | (F.col(col) >= F.lit(threshold))))


def _running(counts: DataFrame, keys: Sequence[str], prefix: str, bucketed: bool) -> DataFrame:
    """``counts`` (keys..., _v, _c and, if ``bucketed``, _vb) with the rows at or
    below each value (``{prefix}_le``) and all rows of the key (``{prefix}_n``).
    Counts run inside a value bucket; what lies in lower buckets comes from the
    table of bucket totals."""
    if not bucketed:
        running = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
        return counts.withColumn(f"{prefix}_le", running).withColumn(
            f"{prefix}_n", F.sum("_c").over(Window.partitionBy(*keys)))
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_vb").orderBy("_v"))
    totals = counts.groupBy(*keys, "_vb").agg(F.sum("_c").alias("_bn"))
    before = Window.partitionBy(*keys).orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_vb", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_before"),
                           F.sum("_bn").over(Window.partitionBy(*keys)).alias(f"{prefix}_n"))
    return (counts.withColumn("_in", inside).join(totals, [*keys, "_vb"])
                  .withColumn(f"{prefix}_le", F.col("_in") + F.col("_before")).drop("_in", "_before"))


def ks_statistic(ref: DataFrame, cur: DataFrame, value: str = "value", by: Sequence[str] = KEY,
                 window_keys: Sequence[str] = ("window_id",),
                 buckets: int | None = None, values_per_bucket: int = VALUES_PER_BUCKET) -> DataFrame:
    """DRF-5/6: two-sample KS statistic ``ks_statistic`` and asymptotic
    ``p_value`` per (by, window_keys), nulls dropped.

    D = max over distinct current values v of the CDF gap at v and just below
    v.  Both samples are first counted per distinct value (map-side combined, so
    a value shared by many rows is one row; the reference's counts are written
    once), then counts run inside value buckets: approximate reference quantiles,
    one for every ``values_per_bucket`` distinct values unless ``buckets`` says how
    many, which only spread the work.
    A key without reference keeps its rows, with null scores and ``ks_status``
    'no_reference'."""
    by, window_keys = list(by), list(window_keys)
    ref = ref.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    cur = cur.where(F.col(value).isNotNull()).select(*by, *window_keys, F.col(value).alias("_v"))
    ref = materialize(ref.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), "reference-values")
    cb = cur.groupBy(*by, *window_keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    buckets = buckets or -(-ref.count() // values_per_bucket)
    rb, slot = ref, []
    if buckets > 1:
        slot = ["_vb"]
        probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        edges = materialize(ref.groupBy(*by).agg(F.array_distinct(
            F.percentile_approx("_v", probs, 100 * buckets)).alias("_e")), "reference-edges")

        def bucketed(d):
            return (d.join(edges, by, "left")
                     .withColumn("_vb", F.coalesce(F.size(F.filter("_e", lambda e: e < F.col("_v"))), F.lit(0)))
                     .drop("_e"))

        rb, cb = bucketed(ref), bucketed(cb)
    # reference counts at the values of the current sample, zero where it has none
    asked = rb.unionByName(cb.select(*by, *slot, "_v", F.lit(0).cast("bigint").alias("_c")))
    asked = asked.groupBy(*by, *slot, "_v").agg(F.sum("_c").alias("_c"))
    r = _running(asked, by, "r", bool(slot)).select(*by, "_v", "r_le", (F.col("r_le") - F.col("_c")).alias("r_lt"), "r_n")
    c = _running(cb, [*by, *window_keys], "c", bool(slot)).join(r, [*by, "_v"])
    n_ref = F.when(F.col("r_n") > 0, F.col("r_n"))
    c_lt = F.col("c_le") - F.col("_c")
    gap = F.greatest(F.abs(F.col("r_le") / n_ref - F.col("c_le") / F.col("c_n")),
                     F.abs(F.col("r_lt") / n_ref - c_lt / F.col("c_n")))
    out = (c.groupBy(*by, *window_keys)
            .agg(F.max(gap).alias("ks_statistic"), F.first("r_n").alias("n_ref"), F.first("c_n").alias("n_cur")))
    p = F.when(F.col("n_ref") > 0, kolmogorov_pvalue("ks_statistic", "n_ref", "n_cur"))
    return out.withColumn("p_value", p).withColumn(
        "ks_status", F.when(F.col("n_ref") > 0, "ok").otherwise("no_reference"))


def unpivot_features(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Wide feature columns -> (keys..., feature, value); missing features
    are skipped."""
    present = [f for f in features if f in df.columns]
    cols = [F.col(f).cast("double") for f in present]
    return (df.select(*keys, *cols)
              .unpivot(list(keys), present, "feature", "value"))


def ks_multi(ref: DataFrame, cur: DataFrame, features: Sequence[str], by: Sequence[str] = KEY,
             window_keys: Sequence[str] = ("window_id",), drift_count: int = 3,
             alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """DRF-7: KS per monitored feature (features missing on either side are
    skipped).  Returns (per_feature, summary): summary holds
    ``drifted_features`` (ordered as given), ``ks_num_drifted`` and
    ``ks_drift``."""
    present = [f for f in features if f in ref.columns and f in cur.columns]
    rl = unpivot_features(ref, present, list(by))
    cl = unpivot_features(cur, present, [*by, *window_keys])
    per = ks_statistic(rl, cl, "value", [*by, "feature"], window_keys)
    per = per.withColumn("is_drift", F.col("p_value") < F.lit(alpha))
    order = F.array_position(F.array(*[F.lit(f) for f in present]), F.col("feature"))
    summary = (per.groupBy(*by, *window_keys)
                  .agg(F.sort_array(F.collect_list(F.when(F.col("is_drift"), F.struct(order.alias("o"), "feature"))))
                       .alias("_d"))
                  .withColumn("drifted_features", F.transform("_d", lambda s: s["feature"]))
                  .withColumn("ks_num_drifted", F.size("drifted_features"))
                  .withColumn("ks_drift", F.col("ks_num_drifted") >= F.lit(drift_count))
                  .drop("_d"))
    return per, summary


def mape_check(df: DataFrame, baseline: str = "baseline_mape", recent: str = "mape",
               alpha: float = 1.15, beta: float = 1.30) -> DataFrame:
    """DRF-8: ratio of recent to baseline MAPE (a zero baseline becomes
    1e-10); >= beta is drift (critical), >= alpha a warning."""
    base = F.when(F.col(baseline) == 0, F.lit(MAPE_BASE_ZERO_GUARD)).otherwise(F.col(baseline))
    ratio = F.col(recent) / base
    return (df.withColumn("mape_ratio", ratio)
              .withColumn("mape_warning", ratio >= F.lit(alpha))
              .withColumn("mape_drift", ratio >= F.lit(beta))
              .withColumn("mape_severity", mape_severity(ratio, alpha, beta)))


def with_baseline(scores: DataFrame, keys: Sequence[str] = KEY, baseline: str = "baseline_mape",
                  recent: str = "mape", order: Sequence[str] = ("window_start", "window_id")) -> DataFrame:
    """DRF-9's fallback: where no baseline is known, the first recent MAPE of the key
    (by ``order``) stands for it.  Rows are window summaries."""
    first = F.min_by(recent, F.struct(*order)).over(Window.partitionBy(*keys))
    return scores.withColumn(baseline, F.coalesce(baseline, first))


def window_drift(ref: DataFrame, cur: DataFrame, cfg: DriftConfig, target: str = "load",
                 by: Sequence[str] = KEY, window_keys: Sequence[str] = ("window_id",), written: bool = False) -> DataFrame:
    """Model-free part of DRF-9 per window: PSI of the target and the KS
    feature vote.  Join the model MAPE and apply ``mape_check`` for the rest."""
    p = psi_check(psi(ref.select(*by, F.col(target).alias("value")),
                      cur.select(*by, *window_keys, F.col(target).alias("value")),
                      "value", by, window_keys, cfg.bins, cfg.epsilon, written=written), cfg.psi_threshold)
    _, ks = ks_multi(ref, cur, cfg.features, by, window_keys, cfg.ks_drift_count, cfg.ks_alpha)
    return p.join(ks, [*by, *window_keys], "left")


def drift_report(df: DataFrame) -> DataFrame:
    """STR-F1: human-readable summary per row of a drift monitor result; the
    drifted feature list appears only when some feature drifted.  The time is that
    of the window (``window_start``, left out where there is none), so a rerun writes
    the same text."""
    time = [F.concat(F.lit("Timestamp: "), F.coalesce(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.lit("None")), F.lit("\n"))
            ] if "window_start" in df.columns else []
    feats = F.when(F.col("ks_num_drifted") > 0,
                   F.concat(F.lit("\n  Features: ["), F.array_join(F.transform(
                       "drifted_features", lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.lit("]"))
                   ).otherwise(F.lit(""))
    text = F.concat(
        F.lit("=== Drift Detection Summary ===\n"),
        *time,
        F.format_string("Overall Drift Detected: %s\n", F.initcap(F.col("overall_drift").cast("string"))),
        F.format_string("[PSI] Value: %.4f, Severity: %s, Drift: %s\n", "psi", "psi_severity",
                        F.initcap(F.col("psi_drift").cast("string"))),
        F.format_string("[KS Test] Drifted features: %d, Drift: %s", "ks_num_drifted",
                        F.initcap(F.col("ks_drift").cast("string"))),
        feats,
        F.format_string("\n[MAPE Monitor] Ratio: %.2fx baseline\n", "mape_ratio"),
        F.format_string("  Base: %.2f%%, Recent: %.2f%%\n", "baseline_mape", "mape"),
        F.format_string("  Severity: %s, Drift: %s", "mape_severity", F.initcap(F.col("mape_drift").cast("string"))))
    return df.withColumn("report", text)
