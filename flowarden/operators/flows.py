"""Packets to bidirectional flows: one hash aggregation, the same on a table and on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import tcp_flag_bits

MIN_DURATION = 0.0001  # fixed value: duration of a flow whose packets share one instant


def _directed(packets: DataFrame) -> DataFrame:
    if "tcp_flags" in packets.columns:
        packets = packets.withColumns(tcp_flag_bits())
    return packets.withColumn("__fwd", F.col("src_ip") < F.col("dst_ip"))


def _flow_aggregates():
    length = F.col("length").cast("double")
    return [
        F.min("time").alias("__start"),
        F.max("time").alias("__end"),
        F.sum(F.when(F.col("__fwd"), length).otherwise(0.0)).alias("fwd_bytes"),
        F.sum(F.when(F.col("__fwd"), 0.0).otherwise(length)).alias("bwd_bytes"),
        F.count(F.lit(1)).alias("total_pkts"),
        F.sum("syn").alias("syn_flag"),
        F.sum("rst").alias("rst_flag"),
        F.sum("fin").alias("fin_flag"),
    ]


def _with_rates(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    span = F.col("__end") - F.col("__start")
    flows = flows.withColumn("flow_duration_s", F.when(span > 0, span).otherwise(F.lit(MIN_DURATION)))
    total = F.col("fwd_bytes") + F.col("bwd_bytes")
    return flows.select(
        *keys,
        (total / F.col("flow_duration_s")).alias("flow_byts_s"),
        (F.col("total_pkts") / F.col("flow_duration_s")).alias("flow_pkts_s"),
        "fwd_bytes",
        "bwd_bytes",
        "total_pkts",
        "syn_flag",
        "rst_flag",
        "fin_flag",
        "flow_duration_s",
        (total / F.col("total_pkts")).alias("pkt_len_mean"),
    )


def assemble_flows(packets: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Flows by unordered endpoint pair and protocol; the smaller address is the source.

    ``within`` adds grouping columns, such as the time window.
    """
    keys = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    d = _directed(packets)
    fwd = F.col("__fwd")
    keyed = d.select(
        *within,
        F.when(fwd, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("src_ip"),
        F.when(fwd, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("dst_ip"),
        F.when(fwd, F.col("src_port")).otherwise(F.col("dst_port")).alias("src_port"),
        F.when(fwd, F.col("dst_port")).otherwise(F.col("src_port")).alias("dst_port"),
        F.when(F.col("protocol").isin("TCP", "UDP"), F.col("protocol")).otherwise("Other").alias("protocol"),
        "time", "length", "syn", "rst", "fin", "__fwd",
    )
    return _with_rates(keyed.groupBy(*within, *keys).agg(*_flow_aggregates()), [*within, *keys])


def assemble_flows_3tuple(packets: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Flows by unordered address pair and each packet's own destination port, protocols mixed."""
    keys = ["src_ip", "dst_ip", "dst_port"]
    d = _directed(packets)
    fwd = F.col("__fwd")
    keyed = d.select(
        *within,
        F.when(fwd, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("src_ip"),
        F.when(fwd, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("dst_ip"),
        "dst_port", "time", "length", "syn", "rst", "fin", "__fwd",
    )
    return _with_rates(keyed.groupBy(*within, *keys).agg(*_flow_aggregates()), [*within, *keys])
