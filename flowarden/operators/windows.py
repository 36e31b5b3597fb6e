"""Time-window aggregates over connection logs and score series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import failed_flag, hour_angle

# Model inputs of a host window.
WINDOW_FEATURES = [
    "n_packets", "n_bytes", "avg_bytes", "std_bytes", "n_dst_ports", "n_dst_ips", "failed_ratio", "hour_sin", "hour_cos",
]


def with_cyclic_hour(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    s, c = hour_angle(F.hour(ts))
    return df.withColumns({"hour": F.hour(ts), "hour_sin": s, "hour_cos": c})


def window_features(df: DataFrame, window: str = "5 minutes", approx_distinct: float | None = None) -> DataFrame:
    """Profile of each source host per tumbling window.

    ``approx_distinct`` (a relative error) trades exact distinct counts for one sketch per group.
    """

    def distinct(c: str) -> Column:
        return F.count_distinct(c) if approx_distinct is None else F.approx_count_distinct(c, approx_distinct)

    agg = df.groupBy(F.window("timestamp", window).alias("w"), "src_ip").agg(
        F.count("bytes").alias("n_packets"),
        F.sum("bytes").alias("n_bytes"),
        F.avg("bytes").alias("avg_bytes"),
        F.coalesce(F.stddev_samp("bytes"), F.lit(0.0)).alias("std_bytes"),
        distinct("dst_port").alias("n_dst_ports"),
        distinct("dst_ip").alias("n_dst_ips"),
        F.sum(failed_flag()).alias("n_failed"),
        F.hour(F.min("timestamp")).alias("hour"),
    )
    s, c = hour_angle(F.col("hour"))
    return agg.select(
        F.col("w.start").alias("window"),
        *[x for x in agg.columns if x != "w"],
        F.when(F.col("n_packets") > 0, F.col("n_failed") / F.col("n_packets")).alias("failed_ratio"),
        s.alias("hour_sin"),
        c.alias("hour_cos"),
    )


def resample(df: DataFrame, ts: str, every: str, measures: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """Regular series from the first to the last bin, empty bins included.

    ``measures`` maps a name to (``sum`` | ``count`` | ``mean`` | ``min`` | ``max``, column). An empty bin
    reads 0 for sum, count and mean, NULL for min and max.
    """
    makers = {"sum": F.sum, "count": F.count, "mean": F.avg, "min": F.min, "max": F.max}
    binned = (
        df.groupBy(F.window(ts, every).alias("w"))
        .agg(*[makers[how](c).alias(name) for name, (how, c) in measures.items()])
        .select(F.col("w.start").alias("bin"), *measures)
    )
    # the two ends are those of the bins, so the rows are read once
    grid = binned.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null")
    grid = grid.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {every}"))).alias("bin"))
    joined = grid.join(binned, "bin", "left")
    out = []
    for name, (how, _) in measures.items():
        out.append(F.coalesce(F.col(name), F.lit(0)).alias(name) if how in ("sum", "count", "mean") else F.col(name))
    return joined.select("bin", *out)


def min_score_per_window(df: DataFrame, window: str = "window", score: str = "if_score") -> DataFrame:
    return df.groupBy(window).agg(F.min(score).alias("min_score"))


def traffic_summary(df: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Record count, first and last time, and the number of anomalies, in one row."""
    out = df.agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    n = anomalies.count() if anomalies is not None else 0
    return out.withColumn("total_anomalies", F.lit(n).cast("long"))


def serve_anomalies(df: DataFrame) -> DataFrame:
    """Report columns: text timestamps, four decimals, whole counts, volume in KB."""
    return df.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "src_ip",
        "type",
        "severity",
        F.round("if_score", 4).alias("if_score"),
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.col("n_packets").cast("long").alias("n_packets"),
        F.col("n_dst_ports").cast("long").alias("n_dst_ports"),
        F.round("failed_ratio", 4).alias("failed_ratio"),
        (F.col("n_bytes") / F.lit(1024.0)).alias("kb"),
    )
