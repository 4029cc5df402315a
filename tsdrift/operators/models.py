"""Forecast models (MDL-1..8).

* ``fit_grouped_linear`` (MDL-8) fits ``y = a + b x`` for every group in one
  aggregation (sufficient statistics), so thousands of retrain candidates are
  fitted by a single shuffle; it is the backtest's model.
* ``fit_forecaster`` (MDL-1) wraps Spark ML gradient-boosted trees for the
  few large fits; ``tune`` (MDL-5) searches a seeded sample of its grid over
  expanding time folds.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsdrift.config import (
    FEATURE_ORDER, GBT_DEFAULTS, MAPE_EPSILON, QUALITY_MAPE_BELOW, QUALITY_R2_ABOVE,
    TUNING_FOLDS, TUNING_ITERATIONS, TUNING_SPACE,
)

from tsdrift.operators import boosting
from tsdrift.session import materialize

KEY = ("series_id",)
PIVOT = 1e-10  # share of a column's own spread below which it counts as a combination of others
FIT_THREADS = 8  # fits submitted side by side


# ---------------------------------------------------------------- metrics
def abs_pct_error(y, yhat) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    yhat = F.col(yhat) if isinstance(yhat, str) else yhat
    return F.abs((y - yhat) / (y + F.lit(MAPE_EPSILON)))


def evaluate(df: DataFrame, y: str = "load", yhat: str = "prediction",
             by: Sequence[str] = KEY) -> DataFrame:
    """MDL-3: MAPE = mean(|(y - yhat) / (y + 1e-8)|) * 100 (signed epsilon),
    RMSE and R2 per group, in one aggregation.  A group of one row or of one
    constant target has no variance to explain: R2 is 1 if every prediction is
    exact, else 0."""
    e = F.col(y) - F.col(yhat)
    spread = F.var_pop(y) * F.count(y)
    flat = F.when(F.sum(e * e) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return (df.groupBy(*by).agg(
        (F.avg(abs_pct_error(y, yhat)) * 100).alias("mape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(spread > 0, F.lit(1.0) - F.try_divide(F.sum(e * e), spread)).otherwise(flat).alias("r2"),
        F.count(F.lit(1)).alias("n")))


def residuals(df: DataFrame, y: str = "load", yhat: str = "prediction") -> DataFrame:
    """MDL-6: residual = y - yhat."""
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def quality_gate(metrics: DataFrame, mape_below: float = QUALITY_MAPE_BELOW,
                 r2_above: float = QUALITY_R2_ABOVE) -> DataFrame:
    """MDL-7: MAPE gate PASS / FAIL and R2 gate PASS / WARN."""
    return (metrics.withColumn("mape_status", F.when(F.col("mape") < mape_below, "PASS").otherwise("FAIL"))
                   .withColumn("r2_status", F.when(F.col("r2") > r2_above, "PASS").otherwise("WARN")))


# ---------------------------------------------------------------- grouped linear model
def linear_coefficients(x: str, y: str) -> list[Column]:
    """Least-squares intercept and slope; a constant x falls back to the mean."""
    slope = F.coalesce(F.regr_slope(F.col(y), F.col(x)), F.lit(0.0))
    intercept = F.coalesce(F.regr_intercept(F.col(y), F.col(x)), F.avg(F.col(y)))
    return [intercept.alias("a"), slope.alias("b"), F.count(F.col(y)).alias("n_fit")]


def fit_grouped_linear(df: DataFrame, by: Sequence[str] = KEY, x: str = "load_lag_24h",
                       y: str = "load") -> DataFrame:
    """MDL-8: one row of coefficients (a, b, n_fit) per group."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(*linear_coefficients(x, y))


def predict_linear(df: DataFrame, model: DataFrame, by: Sequence[str] = KEY,
                   x: str = "load_lag_24h") -> DataFrame:
    """MDL-2 for the grouped model: prediction = a + b x, joined on the group;
    null for a group without a model."""
    return (df.join(model.select(*by, "a", "b"), list(by), "left")
              .withColumn("prediction", F.col("a") + F.col("b") * F.col(x))
              .drop("a", "b"))


# ---------------------------------------------------------------- linear model with many features
def product_columns(xs: Sequence[str], y: str, shift: dict[str, str] | None = None) -> list[Column]:
    """Sufficient statistics of a least-squares fit as columns of one row: 1, the
    values, and their products (upper triangle), null where any value is.  Sums of
    them can be added, and subtracted, across groups.  ``shift`` names a column to
    take off each value (values far from zero lose digits in the products)."""
    cols = [F.col(c).cast("double") - F.col(shift[c]) if shift else F.col(c).cast("double") for c in (*xs, y)]
    all_known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    terms = [F.lit(1.0), *cols, *[cols[i] * cols[j] for i in range(len(cols)) for j in range(i, len(cols))]]
    return [F.when(all_known, t).alias(f"_q{k}") for k, t in enumerate(terms)]


def product_names(xs: Sequence[str]) -> list[str]:
    m = len(xs) + 1
    return [f"_q{k}" for k in range(1 + m + m * (m + 1) // 2)]


def solve_products(sums: DataFrame, xs: Sequence[str], ridge: float = 0.0, shift: Sequence[str] | None = None,
                   keep: Sequence[str] = KEY) -> DataFrame:
    """``keep`` columns, ``intercept``, ``coef`` (array in the order of ``xs``) and
    ``n_fit`` from rows of summed products.

    The centred cross products are eliminated column by column (Gauss-Jordan, as
    they are symmetric and positive no rows need swapping).  A column that is
    constant, or a combination of those before it, has no pivot left (less than
    ``PIVOT`` of its own spread) and gets coefficient 0.  ``ridge`` is added to the
    spread of every feature.  ``shift`` names the columns taken off the values."""
    p, m = len(xs), len(xs) + 1
    n = F.col("_q0")
    total = [F.col(f"_q{1 + i}") for i in range(m)]
    at = {}
    k = 1 + m
    for i in range(m):
        for j in range(i, m):
            at[i, j] = at[j, i] = F.col(f"_q{k}")
            k += 1
    off = [F.col(c) for c in shift] if shift else [F.lit(0.0)] * m
    centred = [[at[i, j] - total[i] * total[j] / n for j in range(m)] for i in range(p)]
    raw = [at[i, i] + F.lit(2.0) * off[i] * total[i] + n * off[i] * off[i] for i in range(p)]  # sum of squares
    spread = [F.when(centred[i][i] > F.lit(PIVOT) * raw[i], centred[i][i]).otherwise(F.lit(0.0)) for i in range(p)]
    matrix = F.array(*[centred[i][j] + F.lit(ridge) if i == j else centred[i][j] for i in range(p) for j in range(m)])
    rows = sums.where(n > 0).select(
        *keep, n.alias("_n"), matrix.alias("_m"), F.array(*spread).alias("_spread"),
        F.array(*[t / n + o for t, o in zip(total, off)]).alias("_mean"))

    def eliminate(state: Column, i: Column) -> Column:
        a = state["a"]
        pivot = F.get(a, i * m + i)
        usable = (F.get(F.col("_spread"), i) > 0) & (pivot > F.lit(PIVOT) * F.get(F.col("_spread"), i))

        def cell(v: Column, c: Column) -> Column:
            row, col = F.floor(c / m).cast("int"), F.pmod(c, F.lit(m))
            own = F.get(a, i * m + col)
            return F.when(row == i, own / pivot).otherwise(v - F.get(a, row * m + i) * own / pivot)

        return F.struct(F.when(usable, F.transform(a, cell)).otherwise(a).alias("a"),
                        F.concat(state["used"], F.array(usable)).alias("used"))

    start = F.struct(F.col("_m").alias("a"), F.array().cast("array<boolean>").alias("used"))
    done = rows.withColumn("_done", F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), start, eliminate))
    coef = F.transform(F.col("_done.used"), lambda u, i: F.when(u, F.get(F.col("_done.a"), i * m + p)).otherwise(F.lit(0.0)))
    done = done.withColumn("coef", coef)
    part = F.aggregate(F.zip_with("coef", F.slice("_mean", 1, p), lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)
    return done.select(*keep, (F.get("_mean", F.lit(p)) - part).alias("intercept"), "coef", F.col("_n").cast("bigint").alias("n_fit"))


def fit_grouped_multilinear(df: DataFrame, by: Sequence[str] = KEY, xs: Sequence[str] = FEATURE_ORDER,
                            y: str = "load", ridge: float = 0.0) -> DataFrame:
    """MDL-8 with many features: one row (by, intercept, coef, n_fit) per group, from
    one aggregation (sums of products, combined map-side) and a solve per group."""
    q = df.select(*by, *product_columns(xs, y)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in product_names(xs)])
    return solve_products(q, xs, ridge, keep=by)


def linear_value(intercept: Column, coef: Column, xs: Sequence[str]) -> Column:
    values = F.array(*[F.col(c).cast("double") for c in xs])
    return intercept + F.aggregate(F.zip_with(coef, values, lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)


def predict_multilinear(df: DataFrame, model: DataFrame, by: Sequence[str] = KEY,
                        xs: Sequence[str] = FEATURE_ORDER) -> DataFrame:
    """MDL-2 for it: null for a group without a model."""
    return (df.join(model.select(*by, "intercept", "coef"), list(by), "left")
              .withColumn("prediction", linear_value(F.col("intercept"), F.col("coef"), xs)).drop("intercept", "coef"))


# ---------------------------------------------------------------- gradient boosted trees
def gbt_pipeline(features: Sequence[str] = FEATURE_ORDER, target: str = "load",
                 n_estimators: int = GBT_DEFAULTS["n_estimators"], max_depth: int = GBT_DEFAULTS["max_depth"],
                 learning_rate: float = GBT_DEFAULTS["learning_rate"],
                 subsample: float = GBT_DEFAULTS["subsample"],
                 colsample_bytree: float = GBT_DEFAULTS["colsample_bytree"],
                 seed: int = GBT_DEFAULTS["seed"]) -> Pipeline:
    """MDL-1: assembler (holds the training feature order) + boosted trees.
    Column sampling is per node in Spark ML, not per tree."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    gbt = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction",
                       maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate,
                       subsamplingRate=subsample, featureSubsetStrategy=str(colsample_bytree),
                       seed=seed, lossType="squared")
    return Pipeline(stages=[asm, gbt])


def fit_forecaster(df: DataFrame, features: Sequence[str] = FEATURE_ORDER, target: str = "load",
                   **params) -> PipelineModel:
    return gbt_pipeline(features, target, **params).fit(df)


def predict(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """MDL-2: score with the training feature order; unfitted model is an error."""
    if model is None:
        raise ValueError("model not trained: fit it first")
    return model.transform(df).drop("features")


def feature_importance(model: PipelineModel, top: int | None = None):
    """MDL-4: (feature, importance), most important first."""
    asm, gbt = model.stages[0], model.stages[-1]
    names = asm.getInputCols()
    imp = gbt.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(names, imp), key=lambda r: (-r[1], r[0]))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top) if top else df


def save_model(model: PipelineModel | None, path: str) -> None:
    """SNK-4: persist model and feature order (kept by the assembler)."""
    if model is None:
        raise ValueError("no model to save")
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def timeseries_folds(df: DataFrame, folds: int = TUNING_FOLDS, ts: str = "ts",
                     keys: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Expanding time folds as in a time-series split: with n rows and
    t = n // (folds + 1), the last ``folds`` blocks of t rows are validation
    parts 1..folds and everything before is part 0; fold k trains on parts
    < k and validates on part k.  Positions come from a range partitioning by
    time (``prefix.range_positions``), so no task holds more than its share of
    the rows, however many fall into one stretch of time.  Fewer rows than
    folds + 1 all go to part 0."""
    from tsdrift.operators.prefix import range_positions

    d = range_positions(df, list(keys), [ts, *tiebreak], "_pos", "_n")
    t = F.floor(F.col("_n") / (folds + 1))
    first = F.col("_n") - t * folds
    part = F.when(F.col("_pos") < first, 0).otherwise(F.floor(F.try_divide(F.col("_pos") - first, t)) + 1)
    return d.withColumn("part", part.cast("int")).drop("_pos", "_n")


def sample_grid(space: dict = TUNING_SPACE, n_iter: int = TUNING_ITERATIONS, seed: int = 42) -> list[dict]:
    """Seeded draw of ``n_iter`` distinct points of the full grid."""
    keys = list(space)
    grid = [{}]
    for k in keys:
        grid = [{**g, k: v} for g in grid for v in space[k]]
    rng = random.Random(seed)
    return rng.sample(grid, min(n_iter, len(grid)))


def first_trees(model: GBTRegressionModel, n: int, spark: SparkSession | None = None) -> GBTRegressionModel:
    """The ensemble of the first ``n`` trees.  Boosting adds trees one after the
    other, each from its own seed, so it equals a fit of ``n`` trees."""
    trees, sc = model.trees, (spark or SparkSession.getActiveSession()).sparkContext
    jvm, ml = sc._jvm, sc._jvm.org.apache.spark.ml.regression
    own = sc._gateway.new_array(ml.DecisionTreeRegressionModel, min(n, len(trees)))
    weights = sc._gateway.new_array(jvm.double, len(own))
    for k in range(len(own)):
        own[k] = trees[k]._java_obj
        weights[k] = float(model.treeWeights[k])
    short = GBTRegressionModel(ml.GBTRegressionModel(f"{model.uid}-{n}", own, weights))
    return short.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def _fits_in_tasks(parts: DataFrame, target: str, features: int, jobs: Sequence[tuple[int, GBTRegressor, set[int]]]) -> dict[int, dict[int, float]]:
    """MAPE of every job (fold, settings, numbers of trees) at each of its numbers of
    trees.  Each fit is one task (``boosting``), the first job first; the rows of a
    fold are one row of arrays that the tasks share, in the order of Spark ML's fit."""
    row = F.struct("_at", F.col(target).alias("y"), vector_to_array("features").alias("x"))

    def as_row(part: DataFrame, name: str) -> DataFrame:
        every = part.withColumn("_at", F.monotonically_increasing_id()).agg(F.sort_array(F.collect_list(row)).alias("r"))
        return every.select(F.transform("r", lambda r: r["y"]).alias(f"{name}_y"),
                            F.flatten(F.transform("r", lambda r: r["x"])).alias(f"{name}_x"))

    spark = parts.sparkSession
    folds = [as_row(parts.where(F.col("part") < k).coalesce(1), "known").crossJoin(as_row(parts.where(F.col("part") == k), "held"))
             .withColumn("fold", F.lit(k)) for k in sorted({k for k, *_ in jobs})]
    settings = [dict(trees=g.getMaxIter(), max_depth=g.getMaxDepth(), learning_rate=g.getStepSize(), subsample=g.getSubsamplingRate(),
                     feature_subset=g.getFeatureSubsetStrategy(), seed=g.getSeed(), max_bins=g.getMaxBins(),
                     least_rows=g.getMinInstancesPerNode(), least_gain=g.getMinInfoGain(), stages=sorted(stages)) for _, g, stages in jobs]

    def fitted(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c).slice(k, 1) for c in batch.schema.names}
                job, held = one["job"][0].as_py(), one["held_y"].flatten()
                y, x, held_x = (one[c].flatten().to_numpy(zero_copy_only=False) for c in ("known_y", "known_x", "held_x"))
                for trees, p in boosting.staged_predictions(x.reshape(-1, features), y, held_x.reshape(-1, features), **settings[job]):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(job, pa.int64()), len(p)), pa.repeat(pa.scalar(trees, pa.int64()), len(p)),
                                                      held, pa.array(p)], names=["_job", "_trees", "y", "prediction"])

    # as many partitions as jobs, and no exchange: every job is a task of its own
    every = spark.range(0, len(jobs), 1, len(jobs)).select(F.col("id").alias("job"), F.get(F.array(*[F.lit(k) for k, *_ in jobs]), F.col("id").cast("int")).alias("fold"))
    scored = every.join(F.broadcast(reduce(DataFrame.unionByName, folds)), "fold").drop("fold").mapInArrow(
        fitted, "_job long, _trees long, y double, prediction double")
    scores = defaultdict(dict)
    for r in evaluate(scored, "y", "prediction", by=["_job", "_trees"]).collect():
        scores[r["_job"]][r["_trees"]] = r["mape"]
    return scores


def _fits_as_jobs(parts: DataFrame, target: str, tasks: int, gbts: dict[tuple, GBTRegressor], fits: dict[tuple, set[int]]) -> dict[tuple, dict[int, float]]:
    """The same for (settings, fold) -> fit by Spark ML, some fits side by side."""
    spark = parts.sparkSession
    known = {k: parts.where(F.col("part") < k).coalesce(tasks).persist() for k in sorted({k for _, k in gbts})}

    def fit(settings: tuple, fold: int) -> dict:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "tune")
        model = gbts[settings, fold].fit(known[fold])
        held_out = parts.where(F.col("part") == fold)
        return {n: evaluate(first_trees(model, n, spark).transform(held_out), target, "prediction", by=[]).first()["mape"] for n in fits[settings]}

    with ThreadPoolExecutor(FIT_THREADS) as pool:
        scores = dict(zip(gbts, pool.map(lambda j: inheritable_thread_target(spark)(fit)(*j), gbts)))
    for d in known.values():
        d.unpersist()
    return scores


def tune(df: DataFrame, features: Sequence[str] = FEATURE_ORDER, target: str = "load",
         space: dict = TUNING_SPACE, n_iter: int = TUNING_ITERATIONS, folds: int = TUNING_FOLDS,
         seed: int = 42, tiebreak: Sequence[str] = KEY, rows_per_task: int = 1 << 18) -> tuple[dict, DataFrame]:
    """MDL-5: lowest mean fold MAPE wins.  Returns the winning settings and the table
    of all candidates.

    The folds are written once, as feature vectors; rows of one time are told apart
    by ``tiebreak``.  Settings that differ only in the number of trees share one fit
    of the most trees, scored at each number by the prefix of its trees.

    Up to ``rows_per_task`` rows, which one task would hold anyway, a fit is one task
    that grows the trees Spark ML would grow (``boosting``), without its job per level.
    Beyond, each fit is a distributed Spark ML job; ``FIT_THREADS`` of them are submitted
    side by side (in a pool of their own, which shares fairly where the session's
    scheduler does).  The loop is over settings, not over data."""
    spark = df.sparkSession
    assembled = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(
        timeseries_folds(df, folds, tiebreak=tiebreak)).select("part", F.col(target).cast("double").alias(target), "features")
    parts = materialize(assembled, "folds", partition_by="part")
    rows = parts.count()
    tasks = max(1, -(-rows // rows_per_task))
    draws = sample_grid(space, n_iter, seed)
    fits = defaultdict(set)  # settings without the number of trees -> numbers of trees
    for d in draws:
        fits[tuple(sorted((k, v) for k, v in d.items() if k != "n_estimators"))].add(d["n_estimators"])
    jobs = sorted(((s, k) for s in fits for k in range(1, folds + 1)), key=lambda j: -max(fits[j[0]]) * dict(j[0]).get("max_depth", 1))
    gbts = {(s, k): gbt_pipeline(features, target, **dict(s), n_estimators=max(fits[s]), seed=seed).getStages()[-1] for s, k in jobs}
    if tasks == 1 and all(boosting.fits_one_pass(rows, len(features), g.getMaxDepth(), g.getMaxBins()) for g in gbts.values()):
        found = _fits_in_tasks(parts, target, len(features), [(k, gbts[s, k], fits[s]) for s, k in jobs])
        scores = {j: found[i] for i, j in enumerate(jobs)}
    else:
        scores = _fits_as_jobs(parts, target, tasks, gbts, fits)
    results = []
    for i, d in enumerate(draws):
        settings = tuple(sorted((k, v) for k, v in d.items() if k != "n_estimators"))
        mean = sum(scores[settings, k][d["n_estimators"]] for k in range(1, folds + 1)) / folds
        results.append((i, *[float(d[k]) for k in space], mean))
    cols = ", ".join(f"{k} double" for k in space)
    table = spark.createDataFrame(results, f"candidate int, {cols}, mean_mape double")
    best = min(results, key=lambda r: (r[-1], r[0]))
    return dict(draws[best[0]]), table
