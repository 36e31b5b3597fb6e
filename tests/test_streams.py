"""The streaming jobs against the same operators on tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from checks.modelled import classes, packet_files
from checks.views import view
from flowarden.operators.alerts import episodes
from flowarden.plans import detection
from flowarden.streaming import keyed
from flowarden.streaming import packets as P


LONGER = "/root/testdata/sf0.01"  # enough packets to close several windows


def run(stream, path):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def write_payload(spark, rows, path, modified):
    """Append one file and give it a modification time, which orders the files of a stream."""
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    spark.createDataFrame(rows, P.PAYLOAD_SCHEMA).coalesce(1).write.mode("append").json(path)
    for name in set(os.listdir(path)) - before:
        if name.startswith("part"):
            os.utime(os.path.join(path, name), (modified, modified))


def packet(t, src="a", dst="b"):
    return (float(t), src, dst, 1, 2, "tcp", 100, 1, None, 0)


def test_payload_defaults(spark):
    df = spark.createDataFrame([(None,) * 10], P.PAYLOAD_SCHEMA)
    got = P.normalise_payload(df, F.timestamp_seconds(F.lit(7))).first()
    assert tuple(got) == (7.0, "192.168.1.100", "10.0.0.1", 1234, 80, "TCP", 64, 0)


def test_late_packets_are_dropped_silently(spark, tmp_path):
    src = str(tmp_path / "in")
    write_payload(spark, [packet(1000), packet(1010)], src, 1_600_000_000)
    write_payload(spark, [packet(1200)], src, 1_600_000_100)
    write_payload(spark, [packet(1300)], src, 1_600_000_200)
    write_payload(spark, [packet(1005), packet(1400)], src, 1_600_000_300)  # 1005 is far behind 1200 - 30
    stream = P.packet_stream(spark, src, files_per_trigger=1)
    got = {r["window"].start: r["total_packets"] for r in run(P.window_counts(stream), str(tmp_path)).collect()}
    start = dt.datetime.fromtimestamp(990, dt.timezone.utc).replace(tzinfo=None)
    assert got[start] == 2 and sum(got.values()) == 4


def test_stream_flows_equal_batch_flows(spark, tmp_path):
    src = packet_files(spark, LONGER)
    batch = P.stream_flows(P.normalise_payload(spark.read.schema(P.PAYLOAD_SCHEMA).parquet(src)))
    got = run(P.stream_flows(P.packet_stream(spark, src, "parquet")), str(tmp_path))
    last = got.agg(F.max("window.end")).first()[0]
    closed = batch.where(F.col("window.end") <= F.lit(last))
    assert got.count() == closed.count() > 0
    assert got.exceptAll(closed.select(*got.columns)).count() == 0


def test_online_job_is_repeatable(spark, sf_dir, tmp_path):
    model = detection.train_hybrid(*classes(spark, sf_dir), "flow_id", n=500, forest_trees=10, trees=3)
    src = packet_files(spark, LONGER)
    out = str(tmp_path / "online")
    detection.online_detect(P.packet_stream(spark, src, "parquet"), model, out, host="10.0.0.1", explain=True).awaitTermination()
    hist = spark.read.parquet(f"{out}/history")
    n = hist.count()
    assert n > 0 and hist.select("id").distinct().count() == n
    assert hist.where("src_ip <> '10.0.0.1' and dst_ip <> '10.0.0.1'").count() == 0
    snap = spark.read.parquet(f"{out}/snapshots")
    assert snap.agg(F.sum("total_flows")).first()[0] == n
    # nothing new arrived: a restart adds nothing
    detection.online_detect(P.packet_stream(spark, src, "parquet"), model, out, host="10.0.0.1", explain=True).awaitTermination()
    assert spark.read.parquet(f"{out}/history").count() == n


def test_online_episodes_over_several_batches(spark, sf_dir, tmp_path):
    alerts = view(spark, sf_dir, "anomaly_rows").select("event_id", "type", F.col("timestamp").cast("timestamp").alias("timestamp"), "if_score", "src_ip")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = [r[0] for r in alerts.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").collect()]
    thirds = [days[: len(days) // 3], days[len(days) // 3 : 2 * len(days) // 3], days[2 * len(days) // 3 :]]
    for i, part in enumerate(thirds):
        alerts.where(F.to_date("timestamp").isin(part)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(alerts.schema).parquet(src)
        P.online_episodes(stream, out, tie=("src_ip", "event_id")).awaitTermination()
    got = {r["event_id"] for r in P.read_online_episodes(spark, out).collect()}
    mark = alerts.agg(F.max("timestamp") - F.expr("INTERVAL 1 MINUTE")).first()[0]
    expect = {r["event_id"] for r in episodes(alerts.where(F.col("timestamp") <= F.lit(mark)), tie=("src_ip", "event_id")).collect()}
    assert got == expect


def test_keyed_episodes_over_restarts(spark, sf_dir, tmp_path):
    keyed.keep_state_on_disk(spark)
    alerts = view(spark, sf_dir, "anomaly_rows").select("event_id", "type", F.col("timestamp").cast("timestamp").alias("timestamp"), "if_score", "src_ip")
    src = str(tmp_path / "in")
    days = [r[0] for r in alerts.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").collect()]
    half = len(days) // 2
    alerts.where(F.to_date("timestamp").isin(days[:half])).coalesce(1).write.parquet(src)
    stream = keyed.keyed_episodes(spark.readStream.schema(alerts.schema).parquet(src), tie=("src_ip", "event_id"))
    first = run(stream, str(tmp_path)).count()
    alerts.where(F.to_date("timestamp").isin(days[half:])).coalesce(1).write.mode("append").parquet(src)
    P.append_last_instant(alerts, src)
    stream = keyed.keyed_episodes(spark.readStream.schema(alerts.schema).parquet(src), tie=("src_ip", "event_id"))
    got = [r["event_id"] for r in run(stream, str(tmp_path)).collect()]
    assert 0 < first < len(got)
    assert sorted(got) == sorted(r["event_id"] for r in episodes(alerts, tie=("src_ip", "event_id")).collect())


def test_snapshot_grid_fills_quiet_windows(spark):
    rows = [packet(1000), packet(1100)]
    f = P.stream_flows(P.normalise_payload(spark.createDataFrame(rows, P.PAYLOAD_SCHEMA)))
    f = f.withColumns({"prob": F.lit(0.9), "is_anomaly": F.lit(1), "if_score": F.lit(0.5), "attack_type": F.lit("X")})
    got = P.snapshot(f, P.window_grid(f)).orderBy("window").collect()
    assert [r["total_flows"] for r in got] == [1, 0, 0, 1] and got[1]["protocols"] == {} and got[0]["attacks"] == {"X": 1}


def test_sliding_windows_overlap(spark):
    p = P.normalise_payload(spark.createDataFrame([packet(1000)], P.PAYLOAD_SCHEMA))
    assert P.window_counts(p, 30, 10).count() == 3


@pytest.mark.parametrize("chart,n", [("protocols", 1), ("top_src_ips", 1)])
def test_dashboard_counts(spark, chart, n):
    f = P.stream_flows(P.normalise_payload(spark.createDataFrame([packet(1000)], P.PAYLOAD_SCHEMA)))
    f = f.withColumns({"prob": F.lit(0.1), "is_anomaly": F.lit(0), "if_score": F.lit(0.5), "attack_type": F.lit("Normal")})
    assert P.dashboard_counts(P.snapshot(f), chart).count() == n
