"""STM-1: drift of live readings against a fixed reference, per event-time
window.

readings (stream) -> stream-static join with the reference breakpoints ->
bin -> watermark -> groupBy(series, window, bin).count() in append mode.  A
window's bin counts are final once the watermark passes its end, so they all
arrive in one micro-batch; ``foreachBatch`` turns them into PSI and severity.
Rows later than the watermark are dropped by Spark's state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsdrift.config import PSI_BINS, PSI_EPSILON
from tsdrift.functions.timecols import epoch_micros, from_epoch_micros
from tsdrift.operators import drift
from tsdrift.session import materialize

KEY = ("series_id",)


def binned_counts(readings: DataFrame, reference: DataFrame, every: str = "1 day",
                  delay: str = "1 hour", bins: int = PSI_BINS) -> DataFrame:
    """Streaming aggregation: rows per (series, event-time window, bin)."""
    bp = drift.quantile_breakpoints(reference, "value", KEY, bins)
    b = drift.assign_bins(readings.where(F.col("value").isNotNull()), bp, "value", KEY)
    # watermarks need TIMESTAMP: map the naive time to the instant with the
    # same epoch micros, so windows align with naive days in any session zone
    b = b.withColumn("ts", F.timestamp_micros(epoch_micros("ts")))
    return (b.withWatermark("ts", delay)
             .groupBy("series_id", F.window("ts", every).alias("w"), F.coalesce("bin", F.lit(-1)).alias("bin"))
             .agg(F.count(F.lit(1)).alias("n")))


def reference_shares(reference: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(series_id, bin, n) of the reference and the breakpoint count."""
    bp = drift.quantile_breakpoints(reference, "value", KEY, bins)
    r = drift.assign_bins(reference.where(F.col("value").isNotNull()), bp, "value", KEY)
    return (r.groupBy("series_id", "bin").agg(F.count(F.lit(1)).alias("n"))
             .join(bp.select("series_id", F.size("bp").alias("n_bp")), "series_id"))


def psi_from_counts(counts: DataFrame, ref_shares: DataFrame, epsilon: float = PSI_EPSILON,
                    threshold: float = 0.25) -> DataFrame:
    """PSI per (series, window) from final bin counts of a micro-batch."""
    rs = ref_shares.groupBy("series_id", "n_bp").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("rmap"), F.sum("n").alias("rn"))
    cs = counts.groupBy("series_id", "w").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("cmap"), F.sum("n").alias("cn"))
    eps = F.lit(epsilon)

    def term(acc, b):
        r = F.coalesce(F.col("rmap")[b], F.lit(0)) / F.col("rn") + eps
        c = F.coalesce(F.col("cmap")[b], F.lit(0)) / F.col("cn") + eps
        return acc + (c - r) * F.ln(c / r)

    p = cs.join(rs, "series_id").select(
        "series_id", from_epoch_micros(F.unix_micros("w.start")).alias("window_start"),
        from_epoch_micros(F.unix_micros("w.end")).alias("window_end"),
        F.aggregate(F.sequence(F.lit(0), F.col("n_bp")), F.lit(0.0), term).alias("psi"))
    return drift.psi_check(p, threshold)


def start_stream_drift(readings: DataFrame, reference: DataFrame, out_path: str, checkpoint: str,
                       every: str = "1 day", delay: str = "1 hour", available_now: bool = True):
    """Run STM-1 into a Parquet table at ``out_path``, one folder per
    micro-batch: a batch replayed after a failure overwrites its own folder, so a
    window is there once.  Windows still open at the end of a bounded replay are
    added by ``close_open_windows``."""
    shares = materialize(reference_shares(reference), "stream-reference")
    counts = binned_counts(readings, reference, every, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        psi_from_counts(batch, shares).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    w = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """All windows written so far."""
    return spark.read.option("basePath", out_path).parquet(f"{out_path}/batch=*").drop("batch")


def close_open_windows(readings: DataFrame, reference: DataFrame, out_path: str, every: str = "1 day",
                       delay: str = "1 hour") -> None:
    """After a bounded replay: score the windows of ``readings`` (the replayed
    rows, as a batch) that no micro-batch emitted, as the watermark never passed
    their end, and write them as batch -1."""
    spark = readings.sparkSession
    done = spark.read.option("basePath", out_path).parquet(f"{out_path}/batch=[0-9]*").select("series_id", "window_start")
    scored = psi_from_counts(binned_counts(readings, reference, every, delay), reference_shares(reference))
    scored.join(done, ["series_id", "window_start"], "left_anti").write.mode("overwrite").parquet(f"{out_path}/batch=-1")
