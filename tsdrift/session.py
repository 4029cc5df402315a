"""Session helpers: settings every plan relies on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

TABLES = "tsdrift-tables"  # folder of written intermediates
_WRITTEN: list[str] = []

# Settings the operators assume.  AQE re-plans shuffles at run time (coalesce
# small partitions, split skewed join partitions); ANSI keeps bad casts loud.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tsdrift") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone.  Only
    when it is unset (local tests) do we create a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tsdrift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df, name: str, partition_by=None):
    """Write ``df`` once as a Parquet table under the shared checkpoint folder
    and return a reader of it.

    Used where a plan is read several times downstream: it cuts the lineage
    (a lost executor re-reads files instead of recomputing the plan), computes
    the input exactly once (a reliable RDD checkpoint of an unpersisted plan
    computes it twice), and later scans get column pruning, filter pushdown
    and, with ``partition_by``, partition pruning."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/{TABLES}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known, also for a table without files


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df, partition: str = "") -> None:
    """Delete the files of a table that ``materialize`` wrote (or of one of its
    partitions, ``column=value``) once nothing reads them any more.  Files
    elsewhere are left alone."""
    for root in {f[:f.index("/", f.index(f"/{TABLES}/") + len(TABLES) + 2)] for f in df.inputFiles() if f"/{TABLES}/" in f}:
        _delete(df.sparkSession, f"{root}/{partition}" if partition else root)


def tables_written() -> list[str]:
    return list(_WRITTEN)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Scope of a job: the tables ``materialize`` writes inside it are deleted at
    its end, so whatever is needed later must be written out before."""
    known = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[known:]:
            _delete(spark, path)
        del _WRITTEN[known:]
