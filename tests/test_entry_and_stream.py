"""Driver contract, backtest invariants and streaming = batch."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tsdrift.config import HOURLY_BACKTEST, HOURLY_DRIFT, HOURLY_POLICIES, PolicySpec
from tsdrift.operators import drift, policies
from tsdrift.plans import backtest, monitor
from tsdrift.sources.fixtures import event_readings
from tsdrift.streaming import drift_stream, policy_stream

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"series_id", "scenario", "window_id", "psi", "n_bins", "psi_severity", "psi_drift"}


def test_oracle_keys_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_backtest_chunking_invariant(spark):
    f = monitor.features(spark, SMOKE)
    one = backtest.run_backtest(f, HOURLY_BACKTEST, HOURLY_DRIFT, HOURLY_POLICIES)
    small = HOURLY_BACKTEST.__class__(**{**HOURLY_BACKTEST.__dict__, "chunk_windows": 2})
    many = backtest.run_backtest(f, small, HOURLY_DRIFT, HOURLY_POLICIES)
    cols = ["series_id", "policy", "scenario", "window_id", "fire", "refit"]
    assert sorted(one.select(*cols).collect()) == sorted(many.select(*cols).collect())
    a = {tuple(r[:4]): r.mape for r in one.select(*cols[:4], "mape").collect()}
    b = {tuple(r[:4]): r.mape for r in many.select(*cols[:4], "mape").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    never = one.where("policy = 'policy0'")
    assert never.where("fire").count() == 0 and never.where("model_time IS NOT NULL").count() == 0


def test_stream_drift_equals_batch(spark):
    out = tempfile.mkdtemp(prefix="tsdrift-out-")
    src = tempfile.mkdtemp(prefix="tsdrift-src-")
    ck = tempfile.mkdtemp(prefix="tsdrift-ck-")
    readings = event_readings(spark, SMOKE)
    ref = readings.where(F.col("ts") < "2024-01-16")
    cur = readings.where(F.col("ts") >= "2024-01-16")
    cur.repartition(4).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(cur.schema).parquet(src)
    q = drift_stream.start_stream_drift(stream, ref, out + "/psi", ck, every="1 day", delay="1 hour")
    q.awaitTermination()
    got = drift_stream.read_windows(spark, out + "/psi")
    closed = got.agg(F.max("window_end")).first()[0]
    batch = drift.psi(ref, cur.withColumn("window_start", F.window("ts", "1 day").start),
                      window_keys=("window_start",))
    b = {(r.series_id, r.window_start): r.psi for r in batch.collect()}
    g = {(r.series_id, r.window_start): r.psi for r in got.collect()}
    assert g and all(abs(g[k] - b[k]) < 1e-9 for k in g)
    assert all(k[1] < closed for k in g)
    for _ in range(2):  # a repeated close changes nothing
        drift_stream.close_open_windows(cur, ref, out + "/psi")
        rows = drift_stream.read_windows(spark, out + "/psi").collect()
        assert len(rows) == len(b) > len(g)  # every (series, day) once
        assert all(abs(r.psi - b[r.series_id, r.window_start]) < 1e-9 for r in rows)


def test_stream_policy_equals_batch(spark):
    spec = PolicySpec("p3", "hybrid", mape_threshold=1.3, min_retrain_interval_hours=168, use_drift_signals=True)
    rows = [("s", h * 3_600_000_000, 1.0, 1.0, c) for h, c in
            zip([0, 168, 200, 336, 400], [True, True, True, False, True])]
    schema = "series_id string, t_us long, mape double, baseline_mape double, overall_drift boolean"
    src = tempfile.mkdtemp(prefix="tsdrift-pol-")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = policy_stream.stream_policy(stream, [spec])
    q = (out.writeStream.outputMode("append").format("memory").queryName("pol_out")
            .option("checkpointLocation", tempfile.mkdtemp(prefix="tsdrift-polck-"))
            .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r.t_us // 3_600_000_000 for r in spark.table("pol_out").where("fire").collect())
    batch = spark.createDataFrame(rows, schema).withColumn("p", F.explode(policies.policy_array([spec])))
    batch = batch.select("*", "p.*").drop("p")
    want = sorted(r.t_us // 3_600_000_000 for r in policies.fire_sequence(batch, ["series_id"]).where("fire").collect())
    assert got == want == [0, 168, 400]
