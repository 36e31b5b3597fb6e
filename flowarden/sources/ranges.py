"""Large captures by byte ranges: a data source whose partitions each find the first record of their range.

A classic capture is a chain of records, each with its length. A task that starts inside one looks for the first offset
from which a long chain of plausible record headers follows (times near those of the file, lengths within the snapshot
length). Finding can be deceived by packet contents, so it is proved: a task walks its records up to the first one
behind its range and compares that place with what the next task finds there. If all agree, the ranges together are
exactly the sequential walk; if one does not, the read fails and says so. Next-generation captures stay whole.

The same proof serves a stream over captures that still grow. An offset holds, for each file, the end of its last whole
record. The driver finds it from the file's tail, and the tasks of the batch, which start at the offset before, must
arrive at exactly that byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from flowarden.sources.captures import PACKET_SCHEMA, decode_capture

RANGE_BYTES = 128 * 1024 * 1024
CHAIN = 48  # headers in a row that must be plausible
MOST_CAPTURED = 262_144  # bytes of one packet, the usual largest snapshot length
HEADER = 24
DAY = 86_400
ORDERS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}


@dataclass
class Range(InputPartition):
    """Records that start in ``low..high`` of the first ``size`` bytes; ``ends`` if a record must end at ``size``."""

    path: str
    low: int
    high: int
    size: int
    base: int = HEADER  # a record is known to start here
    ends: bool = False


@dataclass
class Ranges(InputPartition):
    """What one task reads, a range after the other."""

    parts: list[Range]


def _dealt(ranges: list[Range], step: int, tasks: int) -> list[Ranges]:
    """Neighbouring ranges put together: starting a task costs far more than reading a small capture.

    A task gets at least ``step`` bytes, and with ``tasks`` cores its part of a quarter of all, up to ``RANGE_BYTES``.
    """
    share = sum(r.high - r.low for r in ranges) // (4 * tasks) if tasks else 0
    most, out, held = max(step, min(RANGE_BYTES, share)), [], 0
    for r in ranges:
        if not out or held + r.high - r.low > most:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(r)
        held += r.high - r.low
    return out or [Ranges([])]


def _sizes(options: dict) -> tuple[str, int, int]:
    """Path, bytes of a range, cores (0: not known)."""
    return options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))), int(options.get("cores", 0))


def _open(path: str) -> pa.NativeFile:
    store, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file or of all files below a folder; names that begin with a dot or an underscore are passed over."""
    store, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    found = store.get_file_info(inner)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(inner, recursive=True))
    head = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((head + f.path, f.size) for f in files if f.type == pafs.FileType.File and f.base_name[0] not in "._")


class Walk:
    """Record headers of one classic capture."""

    def __init__(self, file: pa.NativeFile, size: int, base: int = HEADER):
        self.file, self.size, self.base = file, size, base
        self.head = file.read_at(HEADER, 0)
        self.order, self.ticks = ORDERS[bytes(self.head[:4])]
        self.most = max(struct.unpack_from(self.order + "I", self.head, 16)[0], MOST_CAPTURED)
        first = file.read_at(4, HEADER)
        self.begun = struct.unpack(self.order + "I", first)[0] if len(first) == 4 else 0

    def plausible(self, words: np.ndarray) -> np.ndarray:
        """Of [n, 4] header words, which can be a record's."""
        sec, fraction, kept, whole = (words[:, i].astype(np.int64) for i in range(4))
        return (np.abs(sec - self.begun) < 3660 * DAY) & (fraction < self.ticks) & (kept <= self.most) & (kept <= np.maximum(whole, self.most)) & (whole < 1 << 24)

    def first_from(self, low: int) -> int:
        """Offset of the first record that starts at ``low`` or behind it; the size if there is none."""
        if low <= self.base:
            return min(self.base, self.size)
        span = 2 * (16 + self.most)
        data = np.frombuffer(self.file.read_at(span + 16, low), np.uint8)
        if len(data) >= 16:
            word = data[:-3].astype(np.uint32)
            parts = [data[i : len(data) - 3 + i].astype(np.uint32) for i in range(4)]
            word = sum(p << np.uint32(8 * (i if self.order == "<" else 3 - i)) for i, p in enumerate(parts))
            n = len(data) - 15
            words = np.column_stack([word[4 * i : 4 * i + n] for i in range(4)])
            longest, best = 0, self.size
            for start in np.flatnonzero(self.plausible(words)).tolist():
                links, sure = self.chain(low + start)
                if sure:
                    return low + start
                if links > longest:  # at the end of a file whose last record is cut off no chain is sure
                    longest, best = links, low + start
            return best
        return self.size

    def chain(self, at: int) -> tuple[int, bool]:
        """Plausible records in a row from here, and whether they are ``CHAIN`` or end with the file."""
        for links in range(CHAIN):
            if at + 16 > self.size:
                return links, at == self.size
            head = self.file.read_at(16, at)
            words = np.array([struct.unpack(self.order + "4I", head)], np.uint32)
            if not self.plausible(words)[0]:
                return 0, False
            at += 16 + int(words[0, 2])
            if at > self.size:
                return links + 1, False
        return CHAIN, True

    def last_end(self, known: int = HEADER) -> int:
        """End of the last whole record: walked from a known end if that is near, else from the file's tail; 0 before there is one."""
        tail = CHAIN * (16 + self.most)
        start = known if self.size - known <= tail else self.first_from(self.size - tail)
        data, at = self.file.read_at(self.size - start, start), 0
        while at + 16 <= len(data):
            following = at + 16 + struct.unpack_from(self.order + "I", data, at + 8)[0]
            if following > len(data):
                break
            at = following
        return start + at if start + at > HEADER else 0


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step, self.cores = _sizes(options)

    def partitions(self) -> list[Ranges]:
        out = []
        for path, size in _listed(self.path):
            cuts = [0]
            if size > self.step:  # a smaller one is not cut, whatever it is
                with _open(path) as file:
                    if bytes(file.read_at(4, 0)) in ORDERS:
                        cuts = list(range(0, size, self.step))
            out += [Range(path, low, high, size) for low, high in zip(cuts, [*cuts[1:], size])]
        return _dealt(out, self.step, self.cores)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from read_range(part)


class GrowingReader(DataSourceStreamReader):
    """Packets of classic captures that grow, a batch taking all whole records that are there.

    The offset has one entry for each capture in the folder, so rotated captures should leave it in the end; those that
    have left are forgotten. A capture that has become shorter, or whose first batch ended inside a record, is an error.
    With ``closingTime`` the first batch also yields one packet of that time, which lets a bounded stream close its windows.
    """

    def __init__(self, options: dict):
        self.path, self.step, self.cores = _sizes(options)
        closing = options.get("closingtime", options.get("closingTime"))
        self.closing = None if closing is None else float(closing)
        self.seen: dict[str, tuple[int, int]] = {}  # size and end of each capture when it was last looked at

    def initialOffset(self) -> dict:
        return {"ends": {}, "closed": 0}

    def latestOffset(self) -> dict:
        seen = {}
        for path, size in _listed(self.path):
            before, end = self.seen.get(path, (0, 0))
            if size < before:
                raise ValueError(f"{path}: shorter than before; a capture that is replaced needs another name")
            if size != before and size >= HEADER:
                with _open(path) as file:
                    if bytes(file.read_at(4, 0)) not in ORDERS:
                        raise ValueError(f"{path}: only classic captures can be followed while they grow")
                    end = Walk(file, size).last_end(end or HEADER)
            seen[path] = (size, end)
        self.seen = seen
        return {"ends": {path: end for path, (_, end) in seen.items() if end}, "closed": int(self.closing is not None)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out = []
        for path, stop in sorted(end["ends"].items()):
            base = start["ends"].get(path, HEADER)
            if stop < base:
                raise ValueError(f"{path}: shorter than before; a capture that is replaced needs another name")
            cuts = list(range(base, stop, self.step))
            out += [Range(path, low, high, stop, base, True) for low, high in zip(cuts, [*cuts[1:], stop])]
        if end["closed"] > start["closed"]:
            out.append(Range("", 0, 0, 0, ends=True))
        return _dealt(out, self.step, self.cores)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from read_range(part) if part.path else self._closing_row()

    def _closing_row(self) -> Iterator[pa.RecordBatch]:
        empty = {"string": "", "long": 0, "int": 0, "double": 0.0}
        row = {n: empty[t] for n, t in (c.split() for c in PACKET_SCHEMA.split(", "))} | {"time": self.closing}
        return iter([pa.RecordBatch.from_pylist([row], SCHEMA)])


def read_range(partition: Range) -> Iterator[pa.RecordBatch]:
    if not partition.size:
        return
    with _open(partition.path) as file:
        if partition.low == 0 and partition.high == partition.size and not partition.ends:
            head, start, body = b"", 0, file.read_at(partition.size, 0)
        else:
            walk = Walk(file, partition.size, partition.base)
            start, head = walk.first_from(partition.low), bytes(walk.head)
            end = start
            body = file.read_at(max(0, partition.high - start), start)
            while end < partition.high:
                at = end - start
                if len(body) - at < 16:
                    body += file.read_at(walk.most + 16, start + len(body))
                    if len(body) - at < 16:
                        break
                end += 16 + struct.unpack_from(walk.order + "I", body, at + 8)[0]
            if end > start + len(body):
                body += file.read_at(end - start - len(body), start + len(body))
            if partition.high < partition.size:
                astray = end < partition.size and walk.first_from(partition.high) != end
            else:
                astray = partition.ends and end != partition.size
            if astray:
                raise ValueError(f"{partition.path}: no sure record start near byte {partition.high}; read it with a larger rangeBytes")
            body = body[: end - start]
    for packets in decode_capture(head + body):
        packets.insert(0, "path", partition.path)
        packets["seq"] += start  # grows along the file, and no two records start in one byte
        yield pa.RecordBatch.from_pandas(packets, SCHEMA, preserve_index=False)


KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
SCHEMA = pa.schema([(n, KINDS[t]) for n, t in (c.split() for c in PACKET_SCHEMA.split(", "))])


class CaptureRanges(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("capture_ranges").option("rangeBytes", n).load(path)``: packets of a capture or a folder of captures."""

    @classmethod
    def name(cls) -> str:
        return "capture_ranges"

    def schema(self) -> str:
        return PACKET_SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def read_large_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets of captures of any size in ranges of ``range_bytes``; a task reads neighbouring ones. ``seq`` orders the packets of a file.

    The tasks open the path themselves, so it must be a shared folder or a store that pyarrow reaches;
    ``captures.read_capture_packets`` reads what only Spark reaches, below 2 GB a file.
    """
    spark.dataSource.register(CaptureRanges)
    reader = spark.read.format("capture_ranges").option("rangeBytes", range_bytes)
    return reader.option("cores", spark.sparkContext.defaultParallelism).load(path)


def follow_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, closing_time: float | None = None) -> DataFrame:
    """Stream of the packets of a capture, or of a folder of captures, while they are written.

    A restart goes on behind the last record of the last finished batch. ``closing_time``: see ``GrowingReader``.
    """
    spark.dataSource.register(CaptureRanges)
    reader = spark.readStream.format("capture_ranges").option("rangeBytes", range_bytes).option("cores", spark.sparkContext.defaultParallelism)
    if closing_time is not None:
        reader = reader.option("closingTime", closing_time)
        # without it "available now" is a single batch for sources of this kind, and windows close in the one after
        spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", True)
    return reader.load(path)
