"""Packet captures (classic and next-generation files) decoded by Spark tasks, one task per group of files.

Only the walk over record lengths is sequential; header fields of all packets of a file are then read
from the byte buffer with array operations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_SCHEMA = (
    "path string, seq long, time double, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol string, length int, tcp_flags int, icmp_type int"
)
FLAG_LETTERS = "FSRPAUECN"  # fixed value: letter of each TCP flag bit, lowest first
ROWS_PER_BATCH = 100_000


def _records(buf: bytes) -> Iterator[tuple[int, int, float, int]]:
    """(offset, captured length, epoch seconds, link type) of each packet."""
    if len(buf) < 24:
        return
    magic = buf[:4]
    classic = {
        b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6),
        b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9),
    }
    if magic in classic:
        order, tick = classic[magic]
        link = struct.unpack_from(order + "I", buf, 20)[0] & 0xFFFF
        head, at = struct.Struct(order + "IIII"), 24
        while at + 16 <= len(buf):
            sec, frac, kept, _ = head.unpack_from(buf, at)
            if at + 16 + kept > len(buf):
                return
            yield at + 16, kept, sec + frac * tick, link
            at += 16 + kept
        return
    if magic != b"\x0a\x0d\x0d\x0a":
        raise ValueError("not a packet capture")
    order, links, at = "<", [], 0
    while at + 12 <= len(buf):
        if buf[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if buf[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
        kind, size = struct.unpack_from(order + "II", buf, at)
        if size < 12 or at + size > len(buf):
            return
        if kind == 1:
            tick, opt = 1e-6, at + 16
            while opt + 4 <= at + size - 4:
                code, n = struct.unpack_from(order + "HH", buf, opt)
                if code == 0:
                    break
                if code == 9 and n >= 1:
                    r = buf[opt + 4]
                    tick = 2.0 ** -(r & 0x7F) if r & 0x80 else 10.0**-r
                opt += 4 + (n + 3) // 4 * 4
            links.append((struct.unpack_from(order + "H", buf, at + 8)[0], tick))
        elif kind == 6:
            iface, hi, lo, kept = struct.unpack_from(order + "IIII", buf, at + 8)
            link, tick = links[iface]
            yield at + 28, kept, ((hi << 32) | lo) * tick, link
        elif kind == 3 and links:
            kept = min(struct.unpack_from(order + "I", buf, at + 8)[0], size - 16)
            yield at + 12, kept, 0.0, links[0][0]
        at += size


def decode_capture(buf: bytes) -> Iterator[pd.DataFrame]:
    """IPv4 TCP, UDP and ICMP packets of one capture, in bounded batches."""
    data = np.frombuffer(buf, np.uint8)
    seq0, batch = 0, []
    for rec in _records(buf):
        batch.append(rec)
        if len(batch) == ROWS_PER_BATCH:
            yield _decode_batch(data, batch, seq0)
            seq0 += len(batch)
            batch = []
    if batch:
        yield _decode_batch(data, batch, seq0)


def _decode_batch(data: np.ndarray, batch: list, seq0: int) -> pd.DataFrame:
    start, kept, time, link = (np.array(x) for x in zip(*batch))
    end = start + kept
    start, kept, end = start.astype(np.int64), kept.astype(np.int64), end.astype(np.int64)

    def byte(at):
        ok = (at >= 0) & (at < end)
        return np.where(ok, data[np.where(ok, at, 0)], 0).astype(np.int64)

    def word(at):
        return (byte(at) << 8) | byte(at + 1)

    # fixed values: link types 1 Ethernet, 113 cooked, 0 loopback, 101/12/14/228 raw IP
    ip = np.full(len(start), -1, np.int64)
    ether = link == 1
    at = start + 12
    for _ in range(3):  # stacked VLAN tags
        tagged = ether & np.isin(word(at), (0x8100, 0x88A8, 0x9100))
        at = np.where(tagged, at + 4, at)
    ip = np.where(ether & (word(at) == 0x0800), at + 2, ip)
    ip = np.where((link == 113) & (word(start + 14) == 0x0800), start + 16, ip)
    ip = np.where(link == 0, start + 4, ip)
    ip = np.where(np.isin(link, (12, 14, 101, 228)), start, ip)

    head = byte(ip)
    proto = byte(ip + 9)
    first = (word(ip + 6) & 0x1FFF) == 0  # later fragments carry no transport header
    valid = (ip >= 0) & (head >> 4 == 4) & ((head & 15) >= 5) & (ip + 20 <= end) & first & np.isin(proto, (1, 6, 17))
    body = ip + (head & 15) * 4
    need = np.select([proto == 6, proto == 17], [20, 8], 1)
    valid &= body + need <= end

    def address(at):
        return [f"{a}.{b}.{c}.{d}" for a, b, c, d in zip(*(byte(at + i)[valid] for i in range(4)))]

    proto = proto[valid]
    ports = proto != 1
    return pd.DataFrame(
        {
            "seq": (seq0 + np.arange(len(start)))[valid],
            "time": time[valid].astype(float),
            "src_ip": address(ip + 12),
            "dst_ip": address(ip + 16),
            "src_port": np.where(ports, word(body)[valid], 0),
            "dst_port": np.where(ports, word(body + 2)[valid], 0),
            "protocol": np.select([proto == 6, proto == 17], ["TCP", "UDP"], "ICMP"),
            "length": kept[valid],
            "tcp_flags": np.where(proto == 6, ((byte(body + 12) & 1) << 8 | byte(body + 13))[valid], 0),
            "icmp_type": np.where(proto == 1, byte(body)[valid], -1),
        }
    )


def decode_captures(files: DataFrame) -> DataFrame:
    """Packets of a (path, content) table, one row per decoded packet."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for packets in decode_capture(bytes(content)):
                    packets.insert(0, "path", path)
                    yield packets

    return files.select("path", "content").mapInPandas(decode, PACKET_SCHEMA)


def capture_conn_log(packets: DataFrame) -> DataFrame:
    """Decoded packets as connection-log rows: a reset marks failure, flags as letters or ICMP type."""
    tcp, bits = F.col("protocol") == "TCP", F.col("tcp_flags")
    letters = F.concat(
        *[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, letter).otherwise("") for i, letter in enumerate(FLAG_LETTERS)]
    )
    return packets.select(
        F.timestamp_micros(F.round(F.col("time") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("timestamp"),
        "src_ip",
        "dst_ip",
        "dst_port",
        "protocol",
        F.col("length").cast("long").alias("bytes"),
        F.when(tcp & (bits.bitwiseAND(F.lit(4)) != 0), "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(tcp, letters).when(F.col("protocol") == "ICMP", F.col("icmp_type").cast("string")).otherwise("").alias("flags"),
    )


def read_capture_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of every capture at ``path``, ready for flow assembly.

    A capture is read whole by one task, so it must be below Spark's 2 GB value limit; rotate larger ones.
    """
    return decode_captures(spark.read.format("binaryFile").load(path))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return capture_conn_log(read_capture_packets(spark, path)).orderBy("timestamp")
