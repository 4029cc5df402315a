"""Policy comparison (EVL-1..15, TOP-1).

Inputs are the backtest metrics log (one row per run window) and the event
log.  A run is (series_id, policy, scenario); its windows are few, so
per-run windows are cheap, but nothing here gathers a run's rows into one
value except aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.config import (
    BOOTSTRAP_CONF, BOOTSTRAP_REPS, DRIFT_SIGNAL_THRESHOLDS, SMOOTH_WINDOW, WILCOXON_ALPHA,
    WILCOXON_EXACT_MAX_N,
)
from tsdrift.functions.stats import normal_sf
from tsdrift.operators.features import running_min_before, smooth_rolling
from tsdrift.operators.joins import asof_forward, paired_metrics

RUN = ("series_id", "policy", "scenario")


def run_summary(metrics: DataFrame, events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """EVL-1: mean, median, sample std and final MAPE per run; retrain count
    and total refit seconds from the event log (0 without events)."""
    m = metrics.groupBy(*keys).agg(
        F.avg("mape").alias("mean_mape"),
        F.percentile("mape", F.lit(0.5)).alias("median_mape"),
        F.stddev_samp("mape").alias("std_mape"),
        F.max_by("mape", "window_id").alias("final_mape"))
    e = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_retrains"),
        F.coalesce(F.sum("retrain_time_seconds"), F.lit(0.0)).alias("total_retrain_time_seconds"))
    return (m.join(e, list(keys), "left")
             .fillna({"num_retrains": 0, "total_retrain_time_seconds": 0.0})
             .orderBy("scenario", "mean_mape", *keys))


def policy_metrics(metrics: DataFrame, events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """EVL-2: run summary plus min, max and mean refit seconds."""
    extra = metrics.groupBy(*keys).agg(F.max("mape").alias("max_mape"), F.min("mape").alias("min_mape"))
    mean_t = events.groupBy(*keys).agg(F.avg("retrain_time_seconds").alias("mean_retrain_time"))
    return (run_summary(metrics, events, keys).join(extra, list(keys))
            .join(mean_t, list(keys), "left")
            .withColumn("mean_retrain_time", F.coalesce("mean_retrain_time", F.lit(0.0))))


def degradation_rate(metrics: DataFrame, window: int = SMOOTH_WINDOW, keys: Sequence[str] = RUN) -> DataFrame:
    """EVL-3: slope of the smoothed MAPE (rolling mean, partial frames)
    against days since the run's first window."""
    s = smooth_rolling(metrics, "mape", "window_id", keys, window, "smooth")
    first = F.min("timestamp").over(Window.partitionBy(*keys))
    days = F.timestamp_diff("MICROSECOND", first, F.col("timestamp")) / F.lit(86_400_000_000.0)
    return (s.withColumn("days", days).groupBy(*keys)
             .agg(F.regr_slope("smooth", "days").alias("degradation_rate")))


def draw_index(seed: str, rep: Column, i: Column, n: Column) -> Column:
    """Deterministic resampling draw: first 8 hex digits of md5(seed-rep-i)
    modulo n.  Independent of partitioning and re-execution."""
    h = F.md5(F.concat_ws("-", F.lit(seed), rep.cast("string"), i.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), n)


def bootstrap_ci(values: DataFrame, keys: Sequence[str], pos: str = "window_id", value: str = "mape",
                 reps: int = BOOTSTRAP_REPS, conf: float = BOOTSTRAP_CONF, seed: str = "tsdrift") -> DataFrame:
    """EVL-4: percentile interval of ``reps`` resampled means, plus the sample
    mean.  A run is one array of its windows' values in order of ``pos``; its
    replicates are made, folded over the array and sorted into percentiles in the
    task that holds it, so the array travels once.  Runs with equal values have equal
    intervals and are resampled once; different runs are dealt to
    ``spark.sql.shuffle.partitions`` tasks."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(pos).cast("bigint").alias("p"), F.col(value).alias("v"))))
    runs = values.groupBy(*keys).agg(F.avg(value).alias("mean"), pairs.alias("_a")).select(
        *keys, "mean", F.transform("_a", lambda s: s["v"]).alias("_a"))
    n = F.size("_a").cast("bigint")
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps_of = runs.select("_a").distinct().repartition(tasks, "_a").select(
        "_a", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_rep"))
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), n - 1), F.lit(0.0), lambda acc, i: acc + F.get(
        F.col("_a"), draw_index(seed, F.col("_rep"), i, n).cast("int")))
    means = reps_of.select("_a", (total / n).alias("_m"))
    lo, hi = (1 - conf) / 2, (1 + conf) / 2
    ci = means.groupBy("_a").agg(F.percentile("_m", F.lit(lo)).alias("ci_lower"),
                                 F.percentile("_m", F.lit(hi)).alias("ci_upper"))
    return runs.join(ci, "_a").select(*keys, "mean", "ci_lower", "ci_upper")


def _exact_signed_rank_cdf(n: Column, t: Column) -> Column:
    """P(W <= t) for the signed-rank statistic with n untied ranks: subset
    sum counts built by a native array fold (sizes up to n(n+1)/2 + 1)."""
    top = (n * (n + 1) / 2).cast("int")
    init = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def add_rank(c, i):
        return F.transform(F.sequence(F.lit(0), top),
                           lambda s: c[s] + F.when(s >= i, c[s - i]).otherwise(F.lit(0.0)))

    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), init, add_rank)
    below = F.aggregate(F.slice(counts, 1, F.floor(t).cast("int") + 1), F.lit(0.0), lambda a, b: a + b)
    return below / F.pow(F.lit(2.0), n)


def wilcoxon_signed_rank(pairs: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """EVL-5: two-sided Wilcoxon signed-rank test on paired values.  Zero
    differences are dropped; tied |d| get mean ranks; statistic =
    min(W+, W-).  p: exact distribution when n <= 50 without ties, else the
    normal approximation with tie correction.  No non-zero pair: p = 1,
    statistic 0."""
    d = (pairs.withColumn("_d", F.col(a) - F.col(b)).where(F.col("_d") != 0)
              .withColumn("_ad", F.abs("_d")))
    tie = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_ad"))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy("_ad")) + (tie - 1) / 2.0
    d = d.withColumn("_t", tie).withColumn("_r", rank)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nonzero"),
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie_term"),
        F.max("_t").alias("_max_tie"))
    n = F.col("n_nonzero").cast("double")
    stat = F.least("w_plus", "w_minus")
    var = (n * (n + 1) * (2 * n + 1) - 0.5 * F.col("_tie_term")) / 24.0
    z = (stat - n * (n + 1) / 4.0) / F.sqrt(var)
    approx = F.lit(2.0) * normal_sf(F.abs(z))
    exact = F.least(F.lit(1.0), F.lit(2.0) * _exact_signed_rank_cdf(F.col("n_nonzero"), stat))
    use_exact = (F.col("n_nonzero") <= WILCOXON_EXACT_MAX_N) & (F.col("_max_tie") == 1)
    out = g.select(*keys, "n_nonzero", stat.alias("statistic"),
                   F.least(F.lit(1.0), F.when(use_exact, exact).otherwise(approx)).alias("p_value"))
    everyone = pairs.select(*keys).distinct()
    return (everyone.join(out, list(keys), "left")
                    .fillna({"n_nonzero": 0, "statistic": 0.0, "p_value": 1.0}))


def cohens_d(pairs: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """EVL-6: mean difference over sqrt of the mean population variance;
    0 when that is 0."""
    g = pairs.groupBy(*keys).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"),
                                 F.var_pop(a).alias("_va"), F.var_pop(b).alias("_vb"))
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    return g.select(*keys, F.when(pooled > 0, (F.col("_ma") - F.col("_mb")) / pooled)
                    .otherwise(F.lit(0.0)).alias("cohens_d"))


def policy_pairs(metrics: DataFrame, policy_a: str, policies_b: Sequence[str],
                 keys: Sequence[str] = ("series_id", "scenario")) -> DataFrame:
    """Windows of ``policy_a`` paired with those of each of ``policies_b``."""
    mine = metrics.where(F.col("policy") == policy_a).withColumnRenamed("policy", "_pa")
    other = (metrics.where(F.col("policy").isin(list(policies_b)))
                    .withColumnRenamed("policy", "other_policy"))
    return paired_metrics(mine, other, keys, "window_id", "mape").select(*keys, "other_policy", "window_id", "a", "b")


def policy_tests(pairs: DataFrame, keys: Sequence[str], alpha: float = WILCOXON_ALPHA) -> DataFrame:
    """Wilcoxon statistic and p-value, Cohen's d and significance per key."""
    return (wilcoxon_signed_rank(pairs, keys).join(cohens_d(pairs, keys), list(keys))
            .withColumn("significant", F.col("p_value") < alpha))


def compare_policies(metrics: DataFrame, policy_a: str, policies_b: Sequence[str],
                     keys: Sequence[str] = ("series_id", "scenario"), reps: int = BOOTSTRAP_REPS,
                     alpha: float = WILCOXON_ALPHA) -> DataFrame:
    """EVL-7: policy_a against each of policies_b per key: bootstrap means and
    intervals of both, Wilcoxon statistic and p-value, significance, Cohen's d."""
    pairs = policy_pairs(metrics, policy_a, policies_b, keys)
    k = [*keys, "other_policy"]
    # one resampling pass over both sides (side is part of the key)
    long = pairs.select(*k, "window_id", "a", "b").unpivot([*k, "window_id"], ["a", "b"], "_side", "mape")
    boot = bootstrap_ci(long, [*k, "_side"], reps=reps)
    sides = boot.groupBy(*k).pivot("_side", ["a", "b"]).agg(
        F.first("mean").alias("mean"), F.first("ci_lower").alias("ci_lower"), F.first("ci_upper").alias("ci_upper"))
    return policy_tests(pairs, k, alpha).join(sides, k).withColumn("policy", F.lit(policy_a))


def significance_table(metrics: DataFrame, policy_a: str = "policy3",
                       against: Sequence[str] = ("policy0", "policy1")) -> DataFrame:
    """EVL-8: one row per (series, scenario, comparison); tests only, nothing is
    resampled."""
    keys = ["series_id", "scenario", "other_policy"]
    c = policy_tests(policy_pairs(metrics, policy_a, against), keys)
    label = F.concat(F.lit("P3 vs " if policy_a == "policy3" else f"{policy_a} vs "), F.col("other_policy"))
    return c.select("series_id", "scenario", label.alias("comparison"), "p_value", "cohens_d", "significant")


def performance_table(summary: DataFrame) -> DataFrame:
    """EVL-9: the published table columns, 2 decimals."""
    return summary.select(F.col("series_id"), F.col("policy").alias("Policy"), F.col("scenario").alias("Scenario"),
                          F.round("mean_mape", 2).alias("Mean MAPE"), F.round("std_mape", 2).alias("Std Dev"),
                          F.col("num_retrains").alias("Retrains"),
                          F.round("total_retrain_time_seconds", 2).alias("Time (s)"))


def pareto_frontier(summary: DataFrame, keys: Sequence[str] = ("series_id", "scenario")) -> DataFrame:
    """EVL-10: by increasing retrain count, keep runs strictly better than
    every run before them; ties broken by (mean_mape, policy)."""
    s = running_min_before(summary, "mean_mape", ["num_retrains", "mean_mape", "policy"], keys)
    return (s.where(F.col("best_before").isNull() | (F.col("mean_mape") < F.col("best_before")))
             .select(*keys, "policy", "num_retrains", "mean_mape"))


def retrain_pivot(summary: DataFrame, policies: Sequence[str], keys: Sequence[str] = ("series_id", "scenario")) -> DataFrame:
    """EVL-11: scenario rows x policy columns of retrain counts."""
    return summary.groupBy(*keys).pivot("policy", list(policies)).agg(F.first("num_retrains"))


def box_stats(metrics: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """EVL-12: quartiles of MAPE per run and 1.5 IQR whiskers (most extreme
    values inside the fences) with the count of points outside."""
    q = metrics.groupBy(*keys).agg(
        F.percentile("mape", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("_q"))
    q = q.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q_min", "q1", "median", "q3", "q_max"))])
    iqr = F.col("q3") - F.col("q1")
    j = (metrics.select(*keys, "mape").join(q, list(keys))
                .withColumn("_lo", F.col("q1") - 1.5 * iqr).withColumn("_hi", F.col("q3") + 1.5 * iqr))
    inside = (F.col("mape") >= F.col("_lo")) & (F.col("mape") <= F.col("_hi"))
    return j.groupBy(*keys, "q_min", "q1", "median", "q3", "q_max").agg(
        F.min(F.when(inside, F.col("mape"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("mape"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def drift_signals_long(metrics: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """EVL-13: psi, drifted-feature count and MAPE as one long series with
    their plot thresholds; accepts ``ks_drifted`` or ``ks_num_drifted``."""
    ks = "ks_drifted" if "ks_drifted" in metrics.columns else "ks_num_drifted"
    long = (metrics.select(*keys, "window_id", "timestamp", F.col("psi").cast("double"),
                           F.col(ks).cast("double").alias("ks_drifted"), F.col("mape").cast("double"))
                   .unpivot([*keys, "window_id", "timestamp"], ["psi", "ks_drifted", "mape"], "signal", "value"))
    thr = F.create_map(*[x for k, v in DRIFT_SIGNAL_THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    return long.withColumn("threshold", thr[F.col("signal")])


def annotated_events(metrics: DataFrame, events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """EVL-14: each retrain with the MAPE of the first window at or after it
    (the last window's MAPE if none)."""
    return asof_forward(events, metrics, keys, "timestamp", "mape")


def cost_accuracy_points(summary: DataFrame) -> DataFrame:
    """EVL-15: (retrains, mean MAPE) per run."""
    return summary.select("series_id", "policy", "scenario", "num_retrains", "mean_mape")


def top_k(summary: DataFrame, k: int = 10, keys: Sequence[str] = RUN) -> DataFrame:
    """TOP-1: the k runs with the lowest mean MAPE (sort + limit)."""
    return summary.orderBy("mean_mape", *keys).limit(k)
