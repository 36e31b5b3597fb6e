"""Captures read by byte ranges against the sequential walk."""

import random
import struct

import pytest

from flowarden.sources import ranges
from flowarden.sources.captures import decode_capture, read_capture_packets
from flowarden.streaming import packets as P

BASE = 1_700_000_000


def packet(rng, i, padding=0):
    body = struct.pack(">HHIIBB", 1000 + i % 60_000, 443, 0, 0, 0x50, rng.randrange(64))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 0, 0, 0, 64, 6, 0) + bytes([10, 0, i // 256 % 256, i % 256]) + bytes([10, 0, 0, 1])
    return ip + body.ljust(20, b"\0") + bytes(rng.randrange(256) for _ in range(padding))


def capture(n, seed=1, order="<"):
    rng = random.Random(seed)
    out = [struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101)]
    for i in range(n):
        p = packet(rng, i, rng.choice([0, 10, 300]))
        out.append(struct.pack(order + "IIII", BASE + i // 10, i % 10 * 1000, len(p), len(p)) + p)
    return b"".join(out)


COLUMNS = ["time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "tcp_flags", "icmp_type"]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("size", [100, 7_777, 1 << 20])
def test_ranges_are_the_sequential_walk(spark, tmp_path, order, size):
    (tmp_path / "one.pcap").write_bytes(capture(1500, 1, order))
    (tmp_path / "empty.pcap").write_bytes(capture(0))
    (tmp_path / "cut.pcap").write_bytes(capture(40, 2, order)[:-25])  # the last record is not whole
    got = ranges.read_large_captures(spark, str(tmp_path), max(size, 2000))
    want = read_capture_packets(spark, str(tmp_path))
    assert got.count() == want.count() == 1539
    assert got.select(*COLUMNS).exceptAll(want.select(*COLUMNS)).count() == 0
    ordered = [r.time for r in got.where("path LIKE '%one.pcap'").orderBy("seq").collect()]
    assert ordered == sorted(ordered)


def test_a_range_smaller_than_a_record(tmp_path):
    data = capture(200)
    path = tmp_path / "c.pcap"
    path.write_bytes(data)
    reader = ranges.RangeReader({"path": str(path), "rangeBytes": 50})
    rows = [tuple(r) for part in reader.partitions() for b in reader.read(part) for r in b.to_pandas()[COLUMNS].itertuples(index=False)]
    want = [tuple(r) for pdf in decode_capture(data) for r in pdf[COLUMNS].itertuples(index=False)]
    assert rows == want


def test_contents_that_look_like_records_are_no_silent_error(tmp_path):
    fake = struct.pack("<IIII", BASE, 0, 0, 0) * 400  # a packet full of empty records
    p = packet(random.Random(3), 1) + fake
    record = struct.pack("<IIII", BASE, 0, len(p), len(p)) + p
    data = capture(0) + record * 20
    path = tmp_path / "c.pcap"
    path.write_bytes(data)
    reader = ranges.RangeReader({"path": str(path), "rangeBytes": 10_000})
    with pytest.raises(ValueError, match="no sure record start"):
        for part in reader.partitions():
            list(reader.read(part))
    whole = ranges.RangeReader({"path": str(path)})
    assert sum(b.num_rows for part in whole.partitions() for b in whole.read(part)) == 20


def test_above_two_gigabytes(spark, tmp_path):
    """A sparse file: 9,000 records of 240 kB, of which only the headers are written."""
    rng, path, n, length = random.Random(4), tmp_path / "large.pcap", 9_000, 240_000
    with open(path, "wb") as f:
        f.write(capture(0))
        for i in range(n):
            f.seek(24 + i * (16 + length))
            f.write(struct.pack("<IIII", BASE + i, 0, length, length) + packet(rng, i))
        f.truncate(24 + n * (16 + length))
    assert path.stat().st_size > 1 << 31
    got = ranges.read_large_captures(spark, str(path), 96 * 1024 * 1024)
    assert got.rdd.getNumPartitions() > 20
    row = got.selectExpr("count(*) AS n", "count(DISTINCT time) AS t", "count(DISTINCT seq) AS s", "min(time) AS a", "max(time) AS b").first()
    assert tuple(row) == (n, n, n, float(BASE), float(BASE + n - 1))


def drain(stream, at):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


@pytest.mark.parametrize("size", [20_000, 1 << 20])
def test_growing_captures_restart_without_loss_or_repeats(spark, tmp_path, size):
    one, two, folder = capture(900, 5), capture(300, 6, ">"), tmp_path / "in"
    folder.mkdir()
    for share in (0.00001, 0.3, 0.3, 0.701, 1.0):  # cuts lie inside headers and records; once nothing is new
        (folder / "one.pcap").write_bytes(one[: int(len(one) * share)])
        if share > 0.5:
            (folder / "two.pcap").write_bytes(two[: int(len(two) * share)])
        got = drain(ranges.follow_captures(spark, str(folder), size), tmp_path)
        want = [tuple(r) for data in ((one, two) if share > 0.5 else (one,)) for pdf in decode_capture(data[: int(len(data) * share)]) for r in pdf[COLUMNS].itertuples(index=False)]
        assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == sorted(want)
    assert got.select("path", "seq").distinct().count() == 1200


def test_last_end_from_the_tail(tmp_path):
    data, path = capture(60_000, 7), tmp_path / "c.pcap"
    path.write_bytes(data + data[24:40])
    with ranges._open(str(path)) as file:
        walk = ranges.Walk(file, len(data) + 16)
        walk.most = 400  # a tail of 20 kB in a file of some 9 MB
        assert walk.last_end() == len(data) == ranges.Walk(file, len(data)).last_end()
        assert ranges.Walk(file, 30).last_end() == 0


def test_growing_captures_that_cannot_be_followed(tmp_path):
    path = tmp_path / "c.pcap"
    path.write_bytes(capture(30))
    reader = ranges.GrowingReader({"path": str(path)})
    end = reader.latestOffset()
    bad = {"ends": {str(path): end["ends"][str(path)] - 5}, "closed": 0}  # an end inside a record
    with pytest.raises(ValueError, match="no sure record start"):
        [b for part in reader.partitions(reader.initialOffset(), bad) for b in reader.read(part)]
    path.write_bytes(capture(10))
    with pytest.raises(ValueError, match="shorter"):
        reader.latestOffset()
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(end, ranges.GrowingReader({"path": str(path)}).latestOffset())
    path.write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(40))
    with pytest.raises(ValueError, match="classic"):
        ranges.GrowingReader({"path": str(path)}).latestOffset()


def test_a_bounded_capture_stream_closes_its_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pcap").write_bytes(capture(1500))
    got = drain(P.window_counts(P.capture_stream(spark, str(tmp_path / "in"), bounded=True)), tmp_path)
    want = P.window_counts(read_capture_packets(spark, str(tmp_path / "in")))
    assert want.count() > 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_small_captures_share_a_task(tmp_path):
    """A folder of many small captures is read by as many tasks as the cores need, not by one for each."""
    for i in range(300):
        (tmp_path / f"part-{i:03}.pcap").write_bytes(capture(5 + i % 3, i))
    reader = ranges.RangeReader({"path": str(tmp_path), "rangeBytes": 1000, "cores": 4})
    parts = reader.partitions()
    assert 16 <= len(parts) <= 20
    rows = [tuple(r) for part in parts for b in reader.read(part) for r in b.to_pandas()[["path", "seq"]].itertuples(index=False)]
    assert len(rows) == len(set(rows)) == sum(5 + i % 3 for i in range(300))
    reader = ranges.GrowingReader({"path": str(tmp_path), "rangeBytes": 1000, "cores": 4, "closingTime": 1.0})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) <= 20 and sum(b.num_rows for part in parts for b in reader.read(part)) == len(rows) + 1
