"""SRC-2/3 and SNK-1..4: persisted splits, run logs, summaries and models.

Everything is written under a caller-given folder on shared storage
(``run_folder`` derives one from ``spark.checkpoint.dir``), partitioned so
readers prune by partition: ``split=`` for splits, ``policy=/scenario=`` for
run logs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsdrift.session import ensure_checkpoint_dir

EVENT_DDL = ("series_id string, policy string, scenario string, timestamp timestamp_ntz, event string, "
             "retrain_time_seconds double, trigger_reason string")


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark)}/tsdrift-{name}-{uuid.uuid4().hex[:12]}"


def write_splits(features: DataFrame, path: str) -> None:
    """SNK-1: one table partitioned by split."""
    features.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-2: reload a split; the split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_run_logs(metrics: DataFrame, events: DataFrame, path: str) -> None:
    """SNK-2: metrics and event logs partitioned by run; the event log keeps
    its schema when it has no rows."""
    metrics.write.mode("overwrite").partitionBy("policy", "scenario").parquet(f"{path}/metrics")
    events.select(*[F.col(f.name).cast(f.dataType) for f in _event_schema(events.sparkSession).fields]) \
          .write.mode("overwrite").partitionBy("policy", "scenario").parquet(f"{path}/events")


def _event_schema(spark: SparkSession):
    return spark.createDataFrame([], EVENT_DDL).schema


def read_run_logs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC-3: metrics and events of every run under ``root``; run keys come
    from the partition folders; a missing event log means no events."""
    metrics = spark.read.parquet(f"{root}/metrics")
    try:
        events = spark.read.schema(_event_schema(spark)).parquet(f"{root}/events")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        events = spark.createDataFrame([], EVENT_DDL)
    return metrics, events


METRICS_CSV = "timestamp timestamp_ntz, mape double, rmse double, psi double, ks_drifted int, overall_drift boolean"
EVENTS_CSV = "timestamp timestamp_ntz, event string, retrain_time_seconds double, trigger_reason string"


def read_run_log_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-3 for logs as they lie in folders: ``root/{policy}/{scenario}/*_metrics.csv``
    and ``*_events.csv``.  Returns metrics and events with their ``policy`` and
    ``scenario``, taken from the path, and the runs (policy, scenario,
    ``has_event_log``); a run without an event log has no events.

    Each kind of file is one scan with one schema; files elsewhere (above the run
    folders, or of another name) are not matched.  A name that is a folder of part
    files, as Spark writes, is read whole.  Runs are those with a metrics file, be it
    empty; an event log with fewer columns (that of a run without events) is read as
    having nulls there."""

    def scan(kind: str, ddl: str) -> DataFrame:
        run = rf"/([^/]+)/([^/]+)/[^/]*_{kind}\.csv(?:/[^/]*)?$"
        at = F.col("_metadata.file_path")
        try:
            rows = spark.read.schema(ddl).option("header", True).csv(f"{root}/*/*/*_{kind}.csv")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"policy string, scenario string, {ddl}")
        return rows.select(F.url_decode(F.regexp_extract(at, run, 1)).alias("policy"),
                           F.url_decode(F.regexp_extract(at, run, 2)).alias("scenario"), "*")

    def runs(kind: str) -> DataFrame:
        """Runs that have such a file, with or without rows."""
        paths = spark.read.format("binaryFile").load(f"{root}/*/*/*_{kind}.csv") if scans[kind].inputFiles() else None
        if paths is None:
            return spark.createDataFrame([], "policy string, scenario string")
        run = rf"/([^/]+)/([^/]+)/[^/]*_{kind}\.csv(?:/[^/]*)?$"
        return paths.select(*[F.url_decode(F.regexp_extract("path", run, i)).alias(c) for i, c in ((1, "policy"), (2, "scenario"))]).distinct()

    scans = {"metrics": scan("metrics", METRICS_CSV), "events": scan("events", EVENTS_CSV)}
    every, logged = runs("metrics"), runs("events")
    key = ["policy", "scenario"]
    known = every.join(logged, key, "left_semi").withColumn("has_event_log", F.lit(True)).unionByName(
        every.join(logged, key, "left_anti").withColumn("has_event_log", F.lit(False)))
    return scans["metrics"], scans["events"].join(every, key, "left_semi"), known


def write_run_log_files(metrics: DataFrame, events: DataFrame, root: str, run: Sequence[str] = ("policy", "scenario")) -> None:
    """The layout ``read_run_log_files`` reads, written in two jobs: partitions are
    written by run and their folders then named as the log files.  A run without
    events gets no event log."""
    spark = metrics.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for kind, df, ddl in (("metrics", metrics, METRICS_CSV), ("events", events, EVENTS_CSV)):
        base = f"{root}/_{kind}"
        names = [f.split()[0] for f in ddl.split(", ")]
        df.select(*[F.col(k).alias(p) for k, p in zip(run, ("policy", "scenario"))], *names).write.partitionBy(
            "policy", "scenario").option("header", True).csv(base)
        fs = hadoop.Path(base).getFileSystem(conf)
        for d in fs.globStatus(hadoop.Path(f"{base}/policy=*/scenario=*")):  # one per run
            policy, scenario = d.getPath().getParent().getName()[7:], d.getPath().getName()[9:]
            fs.mkdirs(hadoop.Path(f"{root}/{policy}/{scenario}"))
            fs.rename(d.getPath(), hadoop.Path(f"{root}/{policy}/{scenario}/{policy}_{kind}.csv"))
        fs.delete(hadoop.Path(base), True)


def write_summary(summary: DataFrame, path: str) -> None:
    """SNK-3: the sorted summary (sort kept within the single output file set)."""
    summary.write.mode("overwrite").parquet(path)
