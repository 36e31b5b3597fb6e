"""Packet streams: payload source, event-time windows, flows, snapshots, online episodes.

Everything up to the flows works unchanged on a table and on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowarden.functions.scalars import DEFAULT_DST_IP, DEFAULT_SRC_IP
from flowarden.operators.alerts import EPISODE_GAP, episodes
from flowarden.operators.flows import assemble_flows, assemble_flows_3tuple
from flowarden.operators.history import last_n_snapshots
from flowarden.session import materialise, owned_intermediates
from flowarden.sources.ranges import follow_captures

# Payload fields and their defaults, window length, list sizes.
PAYLOAD_SCHEMA = (
    "time double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "length int, syn_flag int, rst_flag int, fin_flag int"
)
PAYLOAD_DEFAULTS = {
    "src_ip": DEFAULT_SRC_IP, "dst_ip": DEFAULT_DST_IP, "src_port": 1234, "dst_port": 80, "protocol": "TCP",
    "length": 64, "syn_flag": 0, "rst_flag": 0, "fin_flag": 0,
}
CONTEXT_SECONDS = 30
END_MARKER = 4_102_444_800.0  # 2100-01-01, in seconds
KEEP_SNAPSHOTS = 30
TOP_IPS = 5
TOP_ALERTS = 25


def normalise_payload(df: DataFrame, now: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Packets from payload rows: defaults filled, protocol upper-cased, flags as a bit mask."""
    now = F.current_timestamp() if now is None else now
    filled = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in PAYLOAD_DEFAULTS.items()}

    def bit(name: str, mask: int) -> Column:
        return F.when(filled[name] != 0, mask).otherwise(0)

    return df.select(
        *keep,
        F.coalesce(F.col("time"), now.cast("timestamp").cast("double")).alias("time"),
        *[filled[k].alias(k) for k in ("src_ip", "dst_ip", "src_port", "dst_port")],
        F.upper(filled["protocol"]).alias("protocol"),
        filled["length"].alias("length"),
        bit("syn_flag", 2).bitwiseOR(bit("rst_flag", 4)).bitwiseOR(bit("fin_flag", 1)).alias("tcp_flags"),
    )


def packet_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of packets from payload files (or any file source with the payload schema)."""
    reader = spark.readStream.format(fmt).schema(PAYLOAD_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return normalise_payload(reader.load(path))


def capture_stream(spark: SparkSession, path: str, bounded: bool = False) -> DataFrame:
    """Stream of packets from captures that are still written.

    A ``bounded`` one is closed by its source: all windows of the packets that are there come out, with nothing added
    to the folder.
    """
    packets = follow_captures(spark, path, closing_time=END_MARKER if bounded else None)
    kept = ["time", "src_ip", "dst_ip", "src_port", "dst_port"]
    return packets.select(*kept, F.upper("protocol").alias("protocol"), "length", "tcp_flags")


def append_end_marker(spark: SparkSession, path: str, fmt: str = "json") -> None:
    """Close the last windows of a bounded stream: add a packet far ahead in event time to its folder.

    A stream releases a window once the watermark has passed it, so without anything newer the last ones would stay
    open. The marker's own window is never passed, so it leaves no row. Write it after all packets.
    """
    marker = spark.createDataFrame([(END_MARKER, *PAYLOAD_DEFAULTS.values())], PAYLOAD_SCHEMA)
    marker.coalesce(1).write.mode("append").format(fmt).save(path)


def with_event_time(packets: DataFrame, name: str = "ts") -> DataFrame:
    return packets.withColumn(name, F.timestamp_micros(F.round(F.col("time") * 1_000_000).cast("long")))


def windowed(packets: DataFrame, seconds: int = CONTEXT_SECONDS, slide: int | None = None, lateness: int | None = None) -> DataFrame:
    """Packets with their context window, tumbling unless ``slide`` is given.

    On a stream a packet later than ``lateness`` (default: one window) behind the newest is dropped.
    """
    timed = with_event_time(packets)
    if timed.isStreaming:
        timed = timed.withWatermark("ts", f"{seconds if lateness is None else lateness} seconds")
    return timed.withColumn("window", F.window("ts", f"{seconds} seconds", f"{slide or seconds} seconds"))


def window_counts(packets: DataFrame, seconds: int = CONTEXT_SECONDS, slide: int | None = None) -> DataFrame:
    w = windowed(packets, seconds, slide)
    return w.groupBy("window").agg(F.count(F.lit(1)).alias("total_packets"), F.sum(F.col("length").cast("long")).alias("total_bytes"))


def stream_flows(packets: DataFrame, seconds: int = CONTEXT_SECONDS, slide: int | None = None) -> DataFrame:
    """Bidirectional flows of each context window."""
    return assemble_flows(windowed(packets, seconds, slide), within=["window"])


def stream_flows_3tuple(packets: DataFrame, seconds: int = CONTEXT_SECONDS, slide: int | None = None) -> DataFrame:
    return assemble_flows_3tuple(windowed(packets, seconds, slide), within=["window"])


def _top_per_window(flows: DataFrame, ip: str, k: int) -> DataFrame:
    counts = flows.groupBy("window", F.col(ip).alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("window").orderBy(F.desc("n"), "ip")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _counts_map(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One map per window; ``rows`` holds few keys per window (protocols, attack types, a top list)."""
    return rows.groupBy("window").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))


def snapshot(scored: DataFrame, grid: DataFrame | None = None, top: int = TOP_IPS) -> DataFrame:
    """One row per window from scored flows: counters, means, and the chart maps.

    ``scored`` carries window, is_anomaly, prob, if_score, attack_type and the flow key. ``grid`` lists the
    windows that must appear; those without flows become zero rows.
    """
    hits, n = F.sum("is_anomaly"), F.count(F.lit(1))
    base = scored.groupBy("window").agg(
        F.sum("total_pkts").alias("total_packets"),
        n.alias("total_flows"),
        (n - hits).alias("normal_flows"),
        hits.alias("attack_flows"),
        (hits / n * 100).alias("detection_rate"),
        (F.avg("prob") * 100).alias("avg_confidence"),
        F.avg("if_score").alias("avg_if_score"),
        F.avg("prob").alias("avg_xgb_prob"),
    )
    protocols = scored.groupBy("window", "protocol").agg(n.alias("n"))
    attacks = scored.where(F.col("is_anomaly") == 1).groupBy("window", "attack_type").agg(n.alias("n"))
    out = base
    for part in (
        _counts_map(protocols, "protocol", "protocols"),
        _counts_map(attacks, "attack_type", "attacks"),
        _counts_map(_top_per_window(scored, "src_ip", top), "ip", "top_src_ips"),
        _counts_map(_top_per_window(scored, "dst_ip", top), "ip", "top_dst_ips"),
    ):
        out = out.join(part, "window", "left")
    if grid is not None:
        out = grid.join(out, "window", "left")
    counters = ["total_packets", "total_flows", "normal_flows", "attack_flows"]
    means = ["detection_rate", "avg_confidence", "avg_if_score", "avg_xgb_prob"]
    maps = ["protocols", "attacks", "top_src_ips", "top_dst_ips"]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.select(
        "window",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters],
        F.lit(0).cast("long").alias("suspicious_flows"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in means],
        *[F.coalesce(c, empty).alias(c) for c in maps],
    )


def window_grid(df: DataFrame, seconds: int = CONTEXT_SECONDS) -> DataFrame:
    """Every tumbling window from the first to the last one present."""
    ends = df.select(F.col("window.start").alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo is not null")
    starts = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {seconds} SECONDS"))).alias("start"))
    return starts.select(F.struct("start", (F.col("start") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("end")).alias("window"))


def dashboard_timeline(snapshots: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """The last snapshots as chart points."""
    return last_n_snapshots(snapshots, keep).select(
        "window",
        F.date_format("window.end", "HH:mm:ss").alias("time"),
        F.col("total_packets").alias("packets"),
        F.col("total_flows").alias("flows"),
        F.col("normal_flows").alias("normal"),
        F.col("attack_flows").alias("attacks"),
        "detection_rate",
    )


def dashboard_counts(snapshots: DataFrame, chart: str, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """Entries of one chart map of the last snapshots, zero counts left out."""
    rows = last_n_snapshots(snapshots, keep).select("window", F.explode(chart).alias("name", "value"))
    return rows.where(F.col("value") > 0)


def ranked_alerts(scored: DataFrame, k: int = TOP_ALERTS) -> DataFrame:
    """Per window and class, the ``k`` flows with the highest confidence."""
    p = F.when(F.col("is_anomaly") == 1, F.col("prob")).otherwise(F.lit(1.0) - F.col("prob"))
    order = Window.partitionBy("window", "is_anomaly").orderBy(F.desc("probability"), "src_ip", "dst_ip", "dst_port")
    return scored.withColumn("probability", p).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def per_window_sink(flows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``handle`` on the flows of newly closed windows of each micro-batch; what it stores in between is deleted after it."""

    def owned(batch: DataFrame, batch_id: int) -> None:
        with owned_intermediates(batch.sparkSession):
            handle(batch, batch_id)

    writer = flows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(owned)
    return (writer.trigger(availableNow=True) if once else writer).start()


def lowest_per_instant(alerts: DataFrame, lateness: str, tie: Sequence[str]) -> DataFrame:
    """Of the alerts of one type and instant only the lowest-scoring can matter; released once the watermark has passed."""
    others = [c for c in alerts.columns if c not in ("type", "timestamp")]
    return (
        alerts.withWatermark("timestamp", lateness)
        .groupBy("type", "timestamp")
        .agg(F.min_by(F.struct(*others), F.struct("if_score", *tie)).alias("row"))
        .select("type", "timestamp", "row.*")
    )


def online_episodes(
    alerts: DataFrame, out: str, gap_seconds: int = EPISODE_GAP, lateness: str = "1 minute", tie: Sequence[str] = ("src_ip",), once: bool = True
):
    """Episode suppression on an alert stream (type, timestamp, if_score, …), written below ``out``.

    The stream keeps the lowest-scoring alert per type and instant and releases it once the watermark has
    passed. Each micro-batch continues the fold from one open representative per type, with the same
    distributed fold as on a table, so a type with most of the alerts is no bottleneck. Batch folders
    are overwritten on retry and each reads only its predecessor's, so a restart repeats nothing.
    """
    lowest = lowest_per_instant(alerts, lateness, tie).select(*alerts.columns)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{out}/open/batch={batch_id - 1}").unionByName(batch)
        found = materialise(episodes(rows, gap_seconds, tie=tie), "episodes")
        newest = found.groupBy(F.col("type").alias("__type")).agg(F.max("timestamp").alias("__newest"))
        tagged = found.join(newest, F.col("type").eqNullSafe(F.col("__type"))).withColumn("__open", F.col("timestamp") == F.col("__newest"))
        for name, part in (("open", F.col("__open")), ("closed", ~F.col("__open"))):
            tagged.where(part).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    return per_window_sink(lowest, handle, f"{out}/checkpoint", once)


def append_last_instant(alerts: DataFrame, path: str) -> None:
    """Close a bounded alert stream: a row far ahead in event time, in a file of its own. Its own instant is never released."""
    last = F.timestamp_seconds(F.lit(END_MARKER)).cast(alerts.schema["timestamp"].dataType)
    marker = alerts.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in alerts.schema])
    marker.withColumn("timestamp", last).coalesce(1).write.mode("append").parquet(path)


def read_online_episodes(spark: SparkSession, out: str) -> DataFrame:
    """Closed episodes of all batches and the ones still open after the last."""
    still_open = spark.read.parquet(f"{out}/open")
    last = still_open.agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{out}/closed").unionByName(still_open.where(F.col("batch") == F.lit(last))).drop("batch")
