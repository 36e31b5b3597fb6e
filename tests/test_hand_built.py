"""Small cases with known answers."""

import datetime as dt
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowarden.functions import scalars as S
from flowarden.models.iforest import IsolationForest
from flowarden.operators import alerts, evaluate, features, flows, history, threats, windows
from flowarden.sources import captures, tables


def test_confusion_arithmetic(spark):
    counts = spark.createDataFrame([(4541, 1459, 2671, 3329)], "tn long, fp long, fn long, tp long")
    m = evaluate.metrics_from_counts(counts).first()
    assert [round(m[c], 3) for c in ("precision", "recall", "f1", "accuracy")] == [0.695, 0.555, 0.617, 0.656]


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, pred int")
    m = evaluate.binary_metrics(df).first()
    assert (m["precision"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.5)


def test_single_packet_flow(spark):
    p = spark.createDataFrame([(5.0, "b", "a", 1, 2, "TCP", 60, 2)], "time double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length int, tcp_flags int")
    f = flows.assemble_flows(p).first()
    assert (f["src_ip"], f["src_port"], f["flow_duration_s"], f["bwd_bytes"], f["syn_flag"]) == ("a", 2, 0.0001, 60.0, 1)
    assert f["flow_pkts_s"] == pytest.approx(10_000)


def test_single_row_window(spark):
    row = (dt.datetime(2024, 1, 1, 5, 3), "h", "d", 80, "TCP", 10, "FAILED", "")
    log = spark.createDataFrame([row], "timestamp timestamp_ntz, src_ip string, dst_ip string, dst_port int, protocol string, bytes long, status string, flags string")
    w = windows.window_features(log).first()
    assert (w["std_bytes"], w["failed_ratio"], w["hour"], w["n_packets"]) == (0.0, 1.0, 5, 1)


@pytest.mark.parametrize("scores,minutes", [((-0.5, -0.6, -0.4), [10]), ((-0.6, -0.5, -0.4), [0, 20])])
def test_moving_representative(spark, scores, minutes):
    rows = [(dt.datetime(2024, 1, 1, 0, 10 * i), "h", "Port Scan", s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, src_ip string, type string, if_score double")
    assert sorted(r["timestamp"].minute for r in alerts.episodes(df).collect()) == minutes


def test_empty_triage_keeps_schema(spark):
    df = spark.createDataFrame([], "timestamp timestamp_ntz, src_ip string, type string, severity string, if_score double")
    out = alerts.severity_rank(alerts.episodes(df), ("timestamp", "src_ip"))
    assert out.count() == 0 and out.columns == [*df.columns, "rank"]


def test_outlier_set(spark):
    # A known-answer set of ten normal hosts and three outliers.
    normal = [(2, 150, 0.01), (3, 200, 0.02), (1, 180, 0.0), (4, 120, 0.03), (2, 170, 0.01), (3, 160, 0.02), (2, 190, 0.0), (1, 140, 0.01), (3, 210, 0.02), (2, 155, 0.01)]
    odd = [(847, 190, 0.02), (3, 5000, 0.01), (2, 165, 0.97)]
    rows = [(i, *map(float, r)) for i, r in enumerate(normal + odd)]
    df = spark.createDataFrame(rows, "id long, ports double, kb double, failed double")
    model = IsolationForest(trees=100, psi=13, seed=7).fit(df, ["ports", "kb", "failed"], "id")
    depth = {r["id"]: r["mean_path"] for r in model.mean_path_length(df).collect()}
    assert max(depth[10], depth[11]) < min(depth[i] for i in range(10))
    scores = {r["id"]: r["if_score"] for r in model.score(df).collect()}
    assert all(-1 <= s < 0 for s in scores.values()) and set(sorted(scores, key=scores.get)[:3]) == {10, 11, 12}


def test_flow_file_rows(spark, tmp_path):
    # second record: 7 + 1 packets over 59.086131 s without payload
    head = "Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Flow Byts/s,Flow Pkts/s,FIN Flag Cnt,SYN Flag Cnt,RST Flag Cnt,Pkt Len Mean,Label"
    (tmp_path / "f.csv").write_text(head + "\n59086131,7,1,0,0,NaN,0.135395563,0,0,0,0,1\n12452268,37,1,2408,68,inf,bad,0,0,0,65.2,1\n")
    df = tables.read_flow_csv(spark, str(tmp_path / "f.csv"))
    a, b = features.featurise_flows(df).collect()
    assert (a["total_pkts"], a["flow_duration_s"], a["flow_byts_s"]) == (8.0, 59.086131, 0.0)
    assert (b["flow_byts_s"], b["flow_pkts_s"]) == (float("inf"), 0.0)


def test_log_checks(spark, tmp_path):
    (tmp_path / "a.log").write_text("timestamp,src_ip,dst_ip,dst_port,bytes,status\n2024-01-01 00:00:01,a,b,80,x,SUCCESS\n")
    row = tables.load_any(spark, str(tmp_path / "a.log")).first()
    assert (row["bytes"], row["protocol"], row["flags"]) == (0, "TCP", "")
    (tmp_path / "b.csv").write_text("timestamp,src_ip\n2024-01-01,a\n")
    with pytest.raises(ValueError, match="lacks columns"):
        tables.load_any(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        tables.load_any(spark, str(tmp_path / "c.xlsx"))


def ipv4(kind, payload, src="1.2.3.4", dst="5.6.7.8", frag=0):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 0, frag, 64, kind, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + payload


def tcp(sport, dport, flags):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)


def ether(ip, tag=b""):
    return b"\0" * 12 + tag + b"\x08\x00" + ip


FRAMES = [
    ether(ipv4(6, tcp(1000, 80, 0x02))),
    ether(ipv4(6, tcp(80, 1000, 0x14)), tag=b"\x81\x00\x00\x05"),
    ether(ipv4(17, struct.pack(">HHHH", 53, 4000, 8, 0))),
    ether(ipv4(1, b"\x08\x00\0\0\0\0\0\0")),
    ether(ipv4(6, tcp(1, 2, 2), frag=5)),  # later fragment: no header to read
    ether(ipv4(47, b"\0" * 8)),
    b"\0" * 12 + b"\x86\xdd" + b"\0" * 40,
]


def classic(order="<", nanos=False):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(FRAMES):
        out += struct.pack(order + "IIII", 100 + i, 500_000_000 if nanos else 500_000, len(f), len(f)) + f
    return out + b"\x01\x02"  # cut-off tail


def next_generation():
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for i, f in enumerate(FRAMES):
        at = (100 + i) * 1_000_000 + 500_000
        out += block(6, struct.pack("<IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


@pytest.mark.parametrize("data", [classic(), classic(">"), classic(nanos=True), next_generation()], ids=["le", "be", "ns", "ng"])
def test_capture_decoding(spark, tmp_path, data):
    (tmp_path / "x.pcap").write_bytes(data)
    rows = tables.load_any(spark, str(tmp_path / "x.pcap")).collect()
    assert [(r["protocol"], r["dst_port"], r["status"], r["flags"]) for r in rows] == [
        ("TCP", 80, "SUCCESS", "S"), ("TCP", 1000, "FAILED", "RA"), ("UDP", 4000, "SUCCESS", ""), ("ICMP", 0, "SUCCESS", "8"),
    ]
    assert rows[0]["timestamp"] == dt.datetime(1970, 1, 1, 0, 1, 40, 500_000) and rows[0]["src_ip"] == "1.2.3.4"
    assert rows[1]["bytes"] == len(FRAMES[1])


def test_capture_batches(monkeypatch):
    monkeypatch.setattr(captures, "ROWS_PER_BATCH", 2)
    parts = list(captures.decode_capture(classic()))
    assert pd.concat(parts)["seq"].tolist() == [0, 1, 2, 3] and len(parts) == 4


def test_scalars(spark):
    df = spark.createDataFrame([("1.5", "NaN", "abc", None)], "a string, b string, c string, d string")
    assert tuple(df.select(*[S.to_numeric(c, 0) for c in df.columns]).first()) == (1.5, 0.0, 0.0, 0.0)
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (-3.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.clean_inf("v", 7, True)).collect()] == [7.0, 7.0, 0.0, 7.0]


@pytest.mark.parametrize(
    "impacts,text",
    [
        ([0.5], "because A0 contributed"),
        ([0.1, 0.5], "because A1, and A0 contributed"),
        ([0.1, 0.2, 0.3, 0.4, 0.5], "because A4, A3, A2, and A1 contributed"),
        ([0.005, -3.0], "subtle deviations"),
    ],
)
def test_explanation(spark, impacts, text):
    items = [(f"a{i}", f"A{i}", v) for i, v in enumerate(impacts)]
    df = spark.createDataFrame([(items,)], f"c {S.IMPACT_TYPE}")
    assert text in df.select(S.explanation_text("c")).first()[0]


def test_attribution_text_round_trip(spark):
    df = spark.createDataFrame([("[]",), ("not json",), (None,)], "j string")
    assert [r[0] for r in df.select(S.attribution_from_json("j")).collect()] == [[], [], []]


def test_threat_context(spark):
    ctx = threats.threat_context(spark)
    top = {r["attack_type"]: r["max_cvss"] for r in threats.max_cvss(ctx).collect()}
    assert top["Port Scan"] == 10.0 and top["Unknown"] is None and len(top) == 7
    odd = spark.createDataFrame([("Never Seen",), ("Brute Force",)], "type string")
    both = {r["type"]: r["context_type"] for r in threats.enrich_threats(odd).collect()}
    assert both == {"Never Seen": "Unknown", "Brute Force": "Brute Force"}
    assert {r["type"] for r in threats.enrich_threats(odd, ctx).collect()} == {"Never Seen", "Brute Force"}


def test_settings(spark):
    w = spark.createDataFrame([(1, "k", "a"), (3, "k", "c"), (2, "k", "b")], "id long, key string, value string")
    assert history.setting(w, "k").first()[0] == "c" and history.setting(w, "zz", "dflt").first()[0] == "dflt"
    full = {r["key"]: r["value"] for r in history.latest_per_key(w, defaults=history.DEFAULT_SETTINGS).collect()}
    assert full["k"] == "c" and full["context_window"] == "30"


def test_timeline_tail(spark):
    df = spark.range(25).withColumn("is_anomaly", (F.col("id") >= 20).cast("int"))
    cut = alerts.timeline_bins(df, ["id"], include_tail=False).agg(F.sum("normal"), F.sum("attacks")).first()
    whole = alerts.timeline_bins(df, ["id"]).agg(F.sum("normal"), F.sum("attacks")).first()
    assert tuple(cut) == (20, 4) and tuple(whole) == (20, 5)


def test_preview(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert tuple(tables.preview(df).first()) == ("1", "", "")


def test_one_hot_refuses_open_ended_columns(spark):
    df = spark.range(50).withColumn("c", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="more than"):
        features.one_hot_aligned(df, df, ["c"], max_values=10)


def test_score_curves_against_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(y, 1.5), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(auc, abs=1e-12)
    cuts = np.unique(s)[::-1]
    p = np.array([(y[s >= c] == 1).mean() for c in cuts])
    r = np.array([(pos >= c).mean() for c in cuts])
    assert evaluate.average_precision(df).first()[0] == pytest.approx(np.sum(np.diff(np.r_[0, r]) * p), abs=1e-12)
    f1 = 2 * p * r / np.maximum(p + r, 1e-9)
    assert evaluate.best_f1_threshold(df).first()["f1"] == pytest.approx(f1.max(), abs=1e-12)


def test_sparse_categories_agree_with_columns(spark):
    from flowarden.operators.features import one_hot_aligned, one_hot_sparse

    train = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, c string")
    test = spark.createDataFrame([(4, "z"), (5, "a")], "id int, c string")
    for wide, sparse in zip(one_hot_aligned(train, test, ["c"]), one_hot_sparse(train, test, ["c"])):
        want = {r.id: [r.c_a, r.c_b, r.c_z] for r in wide.collect()}
        assert {r.id: r.categories.toArray().tolist() for r in sparse.collect()} == want


def test_empty_tables_give_empty_results(spark):
    from flowarden.operators import evaluate

    none = spark.createDataFrame([], "y int, v double, if_score double")
    assert evaluate.histogram(none, "v").count() == evaluate.winsorised_histogram(none, "v").count() == evaluate.threshold_sweep(none).count() == 0


def test_threat_context_is_the_expected_table():
    """The joins are compared with SQL made from the same table, so its values are pinned here."""
    import hashlib
    import json

    from flowarden.operators.threats import THREAT_CONTEXT

    assert hashlib.sha256(json.dumps(THREAT_CONTEXT, sort_keys=True).encode()).hexdigest() == "32e6a669c073f5469ce007fd56184f6426e6fb407720f9ae6007cc6f9b66ad3c"
