"""Queries around files, trained models and running streams. Those with a determined result also have SQL."""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.exact import BUCKET, CORE, CORE_NAMES, EXACT, FIVE_W, TS30, conn, core, episodes_sql, exact, fin, listed
from checks.views import FLOW_HEADERS, oracle, raw_flows, view
from flowarden.functions import scalars as S
from flowarden.models.attribution import Attributor
from flowarden.models.compare import ADABOOST, ALL_MODELS, BOOSTED, FOREST, ISOLATION, compare_models, cross_validate
from flowarden.models.histogram import MEAN, NodeTrees, fit_boosted
from flowarden.models.hybrid import HybridDetector
from flowarden.models.iforest import IsolationForest, IsolationForestModel
from flowarden.models.supervised import TreeEnsemble, fit_adaboost, fit_boosted_trees, fit_random_forest
from flowarden.operators import alerts as A
from flowarden.operators import evaluate as E
from flowarden.operators import history as H
from flowarden.operators import sampling as U
from flowarden.plans import detection as D
from flowarden.plans import studies as ST
from flowarden.plans import triage as TR
from flowarden.session import materialise, scratch_path
from flowarden.sources import captures as C
from flowarden.sources import ranges as R
from flowarden.sources import tables as SRC
from flowarden.streaming import keyed as K
from flowarden.streaming import packets as P

MODELLED: dict = {}

# Sizes of the surveyed project's own runs. Every query fits what it needs itself.
FOREST_TREES, TREES, ROUNDS, FIT_ROWS = 100, 100, 50, 5000


def modelled(name: str):
    def register(fn):
        MODELLED[name] = fn
        return fn

    return register


# ---- sources and sinks ---------------------------------------------------------------------------------
@exact("s1_read_conn_log", oracle(["conn_log"], "SELECT timestamp, src_ip, dst_ip, dst_port, 'TCP' AS protocol, CASE WHEN event_id % 7 = 0 THEN 0 ELSE bytes END AS bytes, status, '' AS flags FROM conn_log"))
def _(s, d):
    path = scratch_path(s, "log")
    junk = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("bytes").cast("string"))
    conn(s, d).select("timestamp", "src_ip", "dst_ip", "dst_port", junk.alias("bytes"), "status").write.option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path, header=True)
    return SRC.read_conn_log(s, path)


def encode_captures(packets):
    """(path, content) rows: classic captures of raw IP packets, one per thousand packet ids."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101)]
        for r in pdf.sort_values("packet_id").itertuples():
            kind = {"TCP": 6, "UDP": 17}.get(r.protocol, 47)
            ip = struct.pack(">BBHHHBBH", 0x45, 0, r.length, 0, 0, 64, kind, 0)
            ip += bytes(map(int, r.src_ip.split("."))) + bytes(map(int, r.dst_ip.split(".")))
            body = struct.pack(">HHIIBB", r.src_port, r.dst_port, 0, 0, 0x50, r.tcp_flags)
            frame = (ip + body).ljust(r.length, b"\0")
            micros = round(r.time * 1_000_000)
            parts.append(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(frame), len(frame)) + frame)
        return pd.DataFrame({"path": [f"part-{pdf['chunk'].iloc[0]}"], "content": [b"".join(parts)]})

    chunked = packets.withColumn("chunk", F.floor(F.col("packet_id") / 1000))
    return chunked.groupBy("chunk").applyInPandas(encode, "path string, content binary")


CAPTURE_SQL = oracle(["packets"], "SELECT make_timestamp(CAST(round(time * 1000000) AS BIGINT)) AS timestamp, src_ip, dst_ip, dst_port, protocol, CAST(length AS BIGINT) AS bytes, CASE WHEN protocol = 'TCP' AND (tcp_flags & 4) <> 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, "
    "CASE WHEN protocol = 'TCP' THEN " + " || ".join(f"CASE WHEN (tcp_flags & {1 << i}) <> 0 THEN '{c}' ELSE '' END" for i, c in enumerate("FSRPAUEC")) + " ELSE '' END AS flags FROM packets WHERE protocol <> 'Other'")


@exact("s2_decode_captures", CAPTURE_SQL)
def _(s, d):
    return C.capture_conn_log(C.decode_captures(encode_captures(view(s, d, "packets"))))


def store_captures(s, d, folder, share=1.0):
    """The packets as capture files, of each the first ``share`` of its bytes."""

    def store(batches):
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with open(f"{folder}/{path}.pcap", "wb") as file:
                    file.write(content[: int(len(content) * share)])
            yield pdf[["path"]]

    encode_captures(view(s, d, "packets")).mapInPandas(store, "path string").count()


@exact("s2_capture_ranges", CAPTURE_SQL)
def _(s, d):
    """The same packets from capture files, each cut into ranges that several tasks read."""
    folder = scratch_path(s, "captures")
    store_captures(s, d, folder)
    return C.capture_conn_log(R.read_large_captures(s, folder, 256 * 1024))


@exact("s11_capture_stream", CAPTURE_SQL)
def _(s, d):
    """Captures followed while they grow: read up to a cut inside a record, then to the end after a restart."""
    folder, out = scratch_path(s, "growing"), scratch_path(s, "followed")
    for share in (0.6, 1.0):
        store_captures(s, d, folder, share)
        got = drain(R.follow_captures(s, folder, 256 * 1024), "followed", out)
    return C.capture_conn_log(got)


@exact("t1_capture_windows", oracle(["packets"], f"w AS (SELECT {TS30} length FROM packets WHERE protocol <> 'Other') SELECT \"window\", count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes FROM w GROUP BY 1"))
def _(s, d):
    """Context windows of a bounded capture stream, all closed by the source."""
    folder = scratch_path(s, "bounded")
    store_captures(s, d, folder)
    out = drain(P.window_counts(P.capture_stream(s, folder, bounded=True)), "capture_windows")
    return out.withColumn("window", F.col("window.start").cast("timestamp_ntz"))


def _flow_columns():
    return ", ".join(f'{c} AS "{h}"' for c, h in FLOW_HEADERS.items())


@exact("s3_read_flow_csv", oracle(["raw_flows"], f"SELECT {_flow_columns()} FROM raw_flows"))
def _(s, d):
    path = scratch_path(s, "flows")
    raw_flows(s, d).drop("flow_id").write.csv(path, header=True)
    return SRC.read_flow_csv(s, path)


KDD_SQL = {c: "CAST(event_id % 100 AS DOUBLE)" for c in SRC.KDD_COLUMNS} | {
    "duration": "duration", "protocol_type": "protocol_type", "service": "service", "flag": "flag",
    "src_bytes": "CAST(src_bytes AS DOUBLE)", "label": "trim(label)", "difficulty": "difficulty",
}


@exact("s4_read_kdd", oracle(["kdd_lite"], "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in KDD_SQL.items()) + " FROM kdd_lite"))
def _(s, d):
    path = scratch_path(s, "kdd")
    view(s, d, "kdd_lite").select(*[F.expr(e).alias(c) for c, e in KDD_SQL.items()]).write.csv(path)
    return SRC.read_kdd(s, path)


@exact("s5_load_any", oracle(["conn_log"], "SELECT timestamp, src_ip, dst_ip, dst_port, protocol, bytes, status, '' AS flags FROM conn_log"))
def _(s, d):
    path = scratch_path(s, "log") + ".csv"
    conn(s, d).select("timestamp", "src_ip", "dst_ip", "dst_port", "protocol", "bytes", "status").write.option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path, header=True)
    return SRC.load_any(s, path)


@exact("s7_write_metrics", oracle(["scored_flows"], "SELECT CAST(y AS STRING) AS model, CAST(round(avg(prob), 4) AS DOUBLE) AS mean_prob, CAST(round(min(if_score), 4) AS DOUBLE) AS low FROM scored_flows GROUP BY y"))
def _(s, d):
    path = scratch_path(s, "metrics")
    per = view(s, d, "scored_flows").groupBy(F.col("y").cast("string").alias("model")).agg(F.avg("prob").alias("mean_prob"), F.min("if_score").alias("low"))
    SRC.write_metrics(per, path)
    return s.read.csv(path, header=True, schema="model string, mean_prob double, low double")


@exact("s8_append_history", oracle(["history"], "h AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY id) + CASE WHEN mode = 'Online' THEN (SELECT count(*) FROM history WHERE mode = 'Offline') ELSE 0 END AS new_id FROM history) "
    "SELECT new_id AS id, mode, src_ip, dst_ip, protocol, dst_port, prediction, confidence, attack_type, if_score, xgb_prob FROM h"))
def _(s, d):
    path = scratch_path(s, "history")
    h = view(s, d, "history").withColumn("contributions", F.array().cast(S.IMPACT_TYPE))
    for mode in ("Offline", "Online"):
        SRC.append_history(h.where(F.col("mode") == mode), path)
    return s.read.parquet(path).select(*[c for c in H.EXPORT_COLUMNS if c != "timestamp"])


# ---- models --------------------------------------------------------------------------------------------
def classes(s, d):
    r = raw_flows(s, d)
    return r.where("Label = 1").drop("Label"), r.where("Label = 0").drop("Label")


def detector(s, d) -> HybridDetector:
    return D.train_hybrid(*classes(s, d), "flow_id", FIT_ROWS, forest_trees=FOREST_TREES, trees=TREES)


def forest(s, d):
    return IsolationForest(FOREST_TREES).fit(fin(s, d), CORE_NAMES, "flow_id")


def training(s, d):
    """What classifiers are fitted on: FIT_ROWS of each class. They are applied to the whole table."""
    return materialise(U.sample_per_class(fin(s, d), FIT_ROWS, 42, "flow_id", "y"), "training")


@modelled("s10_save_load_model")
def _(s, d):
    path = scratch_path(s, "model")
    detector(s, d).save(s, path)
    return HybridDetector.load(s, path).transform(core(s, d)).select("flow_id", "if_score", "prob", "pred")


@exact("s10_round_trip", "SELECT count(*) AS same_rows, CAST(0 AS BIGINT) AS other_rows FROM lineitem")
def _(s, d):
    path, fitted = scratch_path(s, "model"), detector(s, d)
    fitted.save(s, path)
    shown = ["flow_id", "if_score", "prob", "pred"]
    a = fitted.transform(core(s, d)).select("flow_id", F.struct(*shown).alias("a"))
    b = HybridDetector.load(s, path).transform(core(s, d)).select("flow_id", F.struct(*shown).alias("b"))
    same = a.join(b, "flow_id", "full").select(F.col("a").eqNullSafe(F.col("b")).alias("same"))
    return same.agg(F.count(F.when(F.col("same"), 1)).alias("same_rows"), F.count(F.when(~F.col("same"), 1)).alias("other_rows"))


@modelled("a29_split_counts")
def _(s, d):
    return forest(s, d).split_counts(s)


@modelled("a30_mean_path_length")
def _(s, d):
    return forest(s, d).mean_path_length(fin(s, d)).select("flow_id", "mean_path")


@modelled("m1_isolation_forest")
def _(s, d):
    return forest(s, d).node_table(s)


SHAPE_SQL = f"""SELECT CAST(t AS INT) AS tree_id, least(256, n) AS root_n, least(256, n) AS leaf_n, TRUE AS is_binary, TRUE AS is_shallow
FROM (SELECT unnest(range({FOREST_TREES})) AS t), (SELECT count(*) AS n FROM lineitem)"""


@exact("m1_forest_shape", SHAPE_SQL)
def _(s, d):
    """Every tree holds its psi rows in its leaves, has one leaf more than splits and stays within its depth."""
    m = forest(s, d)
    leaf = F.col("feature") < 0
    return m.node_table(s).groupBy("tree_id").agg(
        F.max(F.when(F.col("node_id") == 0, F.col("n"))).cast("long").alias("root_n"), F.sum(F.when(leaf, F.col("n"))).cast("long").alias("leaf_n"),
        (F.sum(F.when(leaf, 1).otherwise(-1)) == 1).alias("is_binary"), (F.max("depth") <= m.limit).alias("is_shallow"),
    )


# A forest written by hand (two trees over total_pkts and syn_flag): scores and paths are then known in SQL.
HAND_NODES = [
    (0, 0, 0, 12.5, 1, 2, 256, 0), (0, 1, 1, 2.5, 3, 4, 200, 1), (0, 2, -1, float("nan"), -1, -1, 56, 1), (0, 3, -1, float("nan"), -1, -1, 150, 2), (0, 4, -1, float("nan"), -1, -1, 50, 2),
    (1, 0, 1, 5.5, 1, 2, 256, 0), (1, 1, -1, float("nan"), -1, -1, 255, 1), (1, 2, -1, float("nan"), -1, -1, 1, 1),
]
HAND_COLUMNS = ["tree_id", "node_id", "feature", "threshold", "left", "right", "n", "depth"]


def hand_forest() -> IsolationForestModel:
    return IsolationForestModel(["total_pkts", "syn_flag"], pd.DataFrame(HAND_NODES, columns=HAND_COLUMNS), 256, 2)


def _unsuccessful(n: str) -> str:
    return f"(CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / CAST({n} AS DOUBLE) END)"


WALK = f"""{CORE}, nodes AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if x != x else repr(x) for x in r) + ")" for r in HAND_NODES)}) AS t({", ".join(f'"{c}"' for c in HAND_COLUMNS)})),
walk AS (SELECT flow_id, total_pkts, syn_flag, tree_id, CAST(0 AS INT) AS node_id FROM core, (SELECT DISTINCT tree_id FROM nodes) t
  UNION ALL SELECT w.flow_id, total_pkts, syn_flag, w.tree_id, CAST(CASE WHEN CASE n.feature WHEN 0 THEN total_pkts ELSE syn_flag END <= n.threshold THEN n."left" ELSE n."right" END AS INT)
  FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE n.feature >= 0),
ended AS (SELECT flow_id, w.tree_id, n.depth, n.n FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE n.feature < 0)"""


@exact("m2_hand_forest_score", oracle(["raw_flows"], WALK + f" SELECT flow_id, -power(2, -(sum(depth + {_unsuccessful('n')}) / 2) / {_unsuccessful('256')}) AS if_score FROM ended GROUP BY flow_id", recursive=True))
def _(s, d):
    return hand_forest().score(core(s, d)).select("flow_id", "if_score")


@exact("a30_hand_mean_path", oracle(["raw_flows"], WALK + " SELECT flow_id, avg(depth) AS mean_path FROM ended GROUP BY flow_id", recursive=True))
def _(s, d):
    return hand_forest().mean_path_length(core(s, d)).select("flow_id", "mean_path")


STEPS_SQL = " SELECT flow_id, n.depth + 1 AS step, w.node_id AS node, CASE n.feature WHEN 0 THEN 'total_pkts' ELSE 'syn_flag' END AS feature, CAST(n.threshold AS DOUBLE) AS threshold, CASE n.feature WHEN 0 THEN total_pkts ELSE syn_flag END AS value, " + (
    "CASE WHEN CASE n.feature WHEN 0 THEN total_pkts ELSE syn_flag END <= n.threshold THEN 'LEFT' ELSE 'RIGHT' END AS direction "
    "FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE n.feature >= 0 AND w.tree_id = 0")


@exact("m4_hand_trace", oracle(["raw_flows"], WALK + STEPS_SQL, recursive=True))
def _(s, d):
    return hand_forest().trace_paths(core(s, d), "flow_id")


@exact("a29_splits_match_leaves", f"SELECT CAST(t AS INT) AS tree_id, TRUE AS one_less FROM (SELECT unnest(range({FOREST_TREES})) AS t)")
def _(s, d):
    """The splits counted per feature add up to one less than the leaves of the tree."""
    m = forest(s, d)
    leaves = m.node_table(s).where("feature < 0").groupBy("tree_id").agg(F.count(F.lit(1)).alias("leaves"))
    counted = m.split_counts(s).groupBy("tree_id").agg(F.sum("splits").alias("splits"))
    return leaves.join(counted, "tree_id").select("tree_id", (F.col("splits") + 1 == F.col("leaves")).alias("one_less"))


# The same two trees as a voting forest: what a random forest's node table does is then known in SQL.
HAND_VOTES = {(0, 2): 0.9, (0, 3): 0.1, (0, 4): 0.6, (1, 1): 0.2, (1, 2): 1.0}
VOTES_SQL = ", votes AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {n}, CAST({v} AS DOUBLE))" for (t, n), v in HAND_VOTES.items()) + """) AS t(tree_id, node_id, value))
SELECT flow_id, avg(v.value) AS prob, CAST(CASE WHEN avg(v.value) > 0.5 THEN 1 ELSE 0 END AS INT) AS pred FROM walk w JOIN votes v ON v.tree_id = w.tree_id AND v.node_id = w.node_id GROUP BY flow_id"""


@exact("m5_hand_forest", oracle(["raw_flows"], WALK + VOTES_SQL, recursive=True))
def _(s, d):
    rows = [(t, n, f, cut, left, right, HAND_VOTES.get((t, n), 0.0), float(size)) for t, n, f, cut, left, right, size, _ in HAND_NODES]
    nodes = pd.DataFrame(rows, columns=["treeID", "id", "feature", "threshold", "left", "right", "value", "cover"])
    return TreeEnsemble(NodeTrees(nodes, MEAN), ["total_pkts", "syn_flag"]).predict(core(s, d)).select("flow_id", "prob", "pred")


# Two rounds of second-order boosting with one split each, followed in SQL: every (feature, cut) is tried on all rows.
def _round_sql(i: int) -> str:
    p = f"(1 / (1 + exp(-f{i})))"
    return f"""
g{i} AS (SELECT x.flow_id, y, a, b, f{i}, {p} - y AS g, {p} * (1 - {p}) AS h FROM x JOIN s{i} ON s{i}.flow_id = x.flow_id),
l{i} AS (SELECT 0 AS f, a AS cut, sum(g) AS g, sum(h) AS h FROM g{i} GROUP BY a UNION ALL SELECT 1, b, sum(g), sum(h) FROM g{i} GROUP BY b),
c{i} AS (SELECT f, cut, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY f) AS g, sum(h) OVER (PARTITION BY f) AS h, max(cut) OVER (PARTITION BY f) AS top
    FROM l{i} WINDOW w AS (PARTITION BY f ORDER BY cut)),
b{i} AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM c{i}
    WHERE cut < top AND hl >= 1 AND h - hl >= 1 ORDER BY gain DESC, f, cut LIMIT 1),
s{i + 1} AS (SELECT flow_id, f{i} - 0.5 * CASE WHEN CASE b{i}.f WHEN 0 THEN a ELSE b END <= b{i}.cut THEN b{i}.gl / (b{i}.hl + 1) ELSE (b{i}.g - b{i}.gl) / (b{i}.h - b{i}.hl + 1) END AS f{i + 1} FROM g{i}, b{i})"""


@exact("m7_two_rounds", oracle(["raw_flows"], CORE + ", x AS (SELECT flow_id, y, least(total_pkts, 20) AS a, syn_flag AS b FROM core), s0 AS (SELECT flow_id, CAST(0 AS DOUBLE) AS f0 FROM x),"
    + ",".join(map(_round_sql, (0, 1))) + " SELECT flow_id, 1 / (1 + exp(-f2)) AS prob FROM s2"))
def _(s, d):
    rows = core(s, d).select("flow_id", "y", F.least("total_pkts", F.lit(20.0)).alias("a"), F.col("syn_flag").alias("b"))
    return TreeEnsemble(fit_boosted(rows, ["a", "b"], "y", trees=2, depth=1, rate=0.5), ["a", "b"]).predict(rows).select("flow_id", "prob")


# Labels by a rule: a classifier that learns at all must find it on every row of the table.
RULE_SQL = oracle(["raw_flows"], CORE + " SELECT flow_id, CASE WHEN total_pkts > 12 THEN 1 ELSE 0 END AS pred FROM core")


def planted(s, d):
    rows = core(s, d).select("flow_id", *[F.when(F.abs(c) < 1e300, F.col(c)).otherwise(0.0).alias(c) for c in CORE_NAMES], (F.col("total_pkts") > 12).cast("int").alias("y"))
    return rows, materialise(U.sample_per_class(rows, FIT_ROWS, 42, "flow_id", "y"), "planted")


@exact("m5_planted_rule", RULE_SQL)
def _(s, d):
    rows, train = planted(s, d)
    return fit_random_forest(train, CORE_NAMES, "y", TREES).predict(rows).select("flow_id", "pred")


@exact("m6_planted_rule", RULE_SQL)
def _(s, d):
    rows, train = planted(s, d)
    return fit_adaboost(train, CORE_NAMES, "y", ROUNDS).predict(rows).select("flow_id", "pred")


@exact("m7_planted_rule", RULE_SQL)
def _(s, d):
    rows, train = planted(s, d)
    return fit_boosted_trees(train, CORE_NAMES, "y", TREES).predict(rows).select("flow_id", "pred")


@modelled("m2_forest_score")
def _(s, d):
    return forest(s, d).score(fin(s, d)).select("flow_id", "if_score")


@modelled("m4_trace_paths")
def _(s, d):
    return forest(s, d).trace_paths(fin(s, d), "flow_id")


@modelled("m5_random_forest")
def _(s, d):
    return fit_random_forest(training(s, d), CORE_NAMES, "y", TREES).predict(fin(s, d)).select("flow_id", "y", "prob", "pred")


@modelled("m6_adaboost")
def _(s, d):
    return fit_adaboost(training(s, d), CORE_NAMES, "y", ROUNDS).predict(fin(s, d)).select("flow_id", "y", "prob", "pred")


@modelled("m7_boosted_trees")
def _(s, d):
    return fit_boosted_trees(training(s, d), CORE_NAMES, "y", TREES).predict(fin(s, d)).select("flow_id", "y", "prob", "pred")


@modelled("m8_hybrid")
def _(s, d):
    return detector(s, d).transform(core(s, d)).select("flow_id", "y", "if_score", "prob", "pred")


@modelled("m9_local_attribution")
def _(s, d):
    m = detector(s, d)
    hits = m.transform(core(s, d), keep_inputs=True).where("pred = 1")
    a = Attributor(s, m.booster.model, m.input_names, m.feature_names).transform(hits)
    return a.select("flow_id", F.posexplode("contributions").alias("pos", "c")).select("flow_id", "pos", "c.feature", "c.impact")


@modelled("m10_cross_validate")
def _(s, d):
    return cross_validate(fin(s, d), CORE_NAMES, 5, trees=TREES, forest_trees=FOREST_TREES)[0]


@modelled("m11_compare_models")
def _(s, d):
    split = U.stratified_split(training(s, d), [0.8, 0.2], "y", "flow_id")
    return compare_models(
        split.where("split = 0"), {"test": split.where("split = 1"), "whole": fin(s, d)}, CORE_NAMES,
        forest_trees=FOREST_TREES, trees=TREES, rounds=ROUNDS,
    )[0]


# ---- streams -------------------------------------------------------------------------------------------
def packet_files(s, d, late: bool = False) -> str:
    """The packets as files a stream can follow, closed by an end marker; ``late`` adds a file of packets that come too late."""
    path = scratch_path(s, "packets")
    p = view(s, d, "packets").withColumns({**{f"{k}_flag": e for k, e in S.tcp_flag_bits().items()}})
    p = p.select("time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "syn_flag", "rst_flag", "fin_flag")
    (p.coalesce(1) if late else p).write.parquet(path)
    P.append_end_marker(s, path, "parquet")
    if late:  # the first window again, two batches after something much newer: then the watermark counts for late rows too
        P.append_end_marker(s, path, "parquet")
        p.where(F.col("time") < 1704067230).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(stream, label, out=None):
    """Run a stream over what is there and return the table it wrote; with the same ``out`` it goes on where it was."""
    s = stream.sparkSession
    out = out or scratch_path(s, label)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@exact("t2_late_data_stream", oracle(["packets"], f"w AS (SELECT {TS30} length FROM packets) SELECT \"window\", count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes FROM w GROUP BY 1"))
def _(s, d):
    # a file per batch: the repeated first window comes after the watermark and is dropped
    out = drain(P.window_counts(P.packet_stream(s, packet_files(s, d, late=True), "parquet", files_per_trigger=1)), "counts")
    return out.withColumn("window", F.col("window.start").cast("timestamp_ntz"))


@exact("t3_flows_on_stream", oracle(["packets"], FIVE_W + " SELECT fl.* FROM fl"))
def _(s, d):
    p = P.packet_stream(s, packet_files(s, d), "parquet")
    named = p.withColumn("protocol", F.when(F.col("protocol") == "OTHER", "Other").otherwise(F.col("protocol")))
    return drain(P.stream_flows(named), "stream_flows").withColumn("window", F.col("window.start").cast("timestamp_ntz"))


def online_run(s, d, model=None):
    out = scratch_path(s, "online")
    D.online_detect(P.packet_stream(s, packet_files(s, d), "parquet"), model or detector(s, d), out).awaitTermination()
    return out


@modelled("t4_stream_score")
def _(s, d):
    return s.read.parquet(f"{online_run(s, d)}/history").drop("batch", "shap_explanation")


EPISODES_SQL = oracle(["anomaly_rows"], episodes_sql("anomaly_rows", "event_id")
    + " SELECT a.event_id, a.type, a.timestamp, a.if_score FROM anomaly_rows a JOIN kept ON kept.type = a.type AND kept.k = CAST(a.event_id AS VARCHAR)", recursive=True)


def alert_files(s, d):
    """The alerts as files a stream can follow, closed by a row far ahead."""
    path = scratch_path(s, "alerts")
    alerts = view(s, d, "anomaly_rows").select("event_id", "type", F.col("timestamp").cast("timestamp").alias("timestamp"), "if_score", "src_ip")
    alerts.write.parquet(path)
    P.append_last_instant(alerts, path)
    return s.readStream.schema(alerts.schema).parquet(path)


@exact("t8_online_episodes", EPISODES_SQL)
def _(s, d):
    out = scratch_path(s, "episodes")
    P.online_episodes(alert_files(s, d), out, tie=("src_ip", "event_id")).awaitTermination()
    done = P.read_online_episodes(s, out)
    return done.select("event_id", "type", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "if_score")


@exact("t8_keyed_episodes", EPISODES_SQL)
def _(s, d):
    K.keep_state_on_disk(s)
    done = drain(K.keyed_episodes(alert_files(s, d), tie=("src_ip", "event_id")), "keyed")
    return done.select("event_id", "type", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "if_score")


def cells(metrics, by):
    """Rows a model was judged on, by true class: the cells of its confusion table added up."""
    return metrics.select(*by, (F.col("tn") + F.col("fp")).cast("long").alias("normal"), (F.col("fn") + F.col("tp")).cast("long").alias("attack"))


@exact("m10_folds_hold_every_row", oracle(["raw_flows"], """
SELECT f AS fold, CAST(sum(CASE WHEN label = 0 AND (r - 1) % 5 = f THEN 1 ELSE 0 END) AS BIGINT) AS normal, CAST(sum(CASE WHEN label = 1 AND (r - 1) % 5 = f THEN 1 ELSE 0 END) AS BIGINT) AS attack
FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY flow_id) AS r FROM raw_flows), (SELECT CAST(unnest(range(5)) AS INT) AS f) GROUP BY f"""))
def _(s, d):
    return cells(cross_validate(fin(s, d), CORE_NAMES, 5, trees=TREES, forest_trees=FOREST_TREES)[0], ["fold"])


# ---- composites ----------------------------------------------------------------------------------------
def traffic(s, d):
    return TR.analyze_traffic(conn(s, d), 0.02, "5 minutes", FOREST_TREES)


@modelled("q1_analyze_traffic")
def _(s, d):
    return traffic(s, d)[1]


def offline(s, d):
    return D.offline_detect(raw_flows(s, d), detector(s, d), "flow_id")


@modelled("q2_offline_detect")
def _(s, d):
    return offline(s, d).summary


@modelled("q2_offline_timeline")
def _(s, d):
    return offline(s, d).timeline


@exact("q2_offline_store", "SELECT 'Offline' AS mode, count(*) AS stored, count(*) AS explained_if_flagged FROM lineitem")
def _(s, d):
    """The whole offline run with attribution and history: every flow is stored, contributions with the flagged ones alone."""
    path = scratch_path(s, "store")
    D.offline_detect(raw_flows(s, d), detector(s, d), "flow_id", explain=True, history_path=path)
    explained = F.length("shap_explanation") > 2
    return s.read.parquet(path).groupBy("mode").agg(F.count(F.lit(1)).alias("stored"), F.count(F.when(explained == (F.col("prediction") == 1), 1)).alias("explained_if_flagged"))


@exact("q3_online_store", oracle(["packets"], FIVE_W + " SELECT strftime(\"window\" + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS timestamp, count(*) AS stored, count(DISTINCT (src_ip, dst_ip, src_port, dst_port, protocol)) AS ids FROM fl GROUP BY 1"))
def _(s, d):
    """The online run with attribution: the history holds every flow of every window, each under its own id."""
    out = scratch_path(s, "online")
    D.online_detect(P.packet_stream(s, packet_files(s, d), "parquet"), detector(s, d), out, explain=True).awaitTermination()
    return s.read.parquet(f"{out}/history").groupBy("timestamp").agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("id").alias("ids"))


@modelled("q3_online_detect")
def _(s, d):
    snap = s.read.parquet(f"{online_run(s, d)}/snapshots")
    return snap.select(F.col("window.start").alias("window"), "total_packets", "total_flows", "attack_flows", "detection_rate", "avg_xgb_prob")


@modelled("q4_train_hybrid")
def _(s, d):
    return E.binary_metrics(detector(s, d).transform(core(s, d)))


@modelled("q5_flow_report")
def _(s, d):
    return ST.flow_report(*classes(s, d), "flow_id")["report"]


RAW_FEATURES = ["Flow Byts/s", "Flow Pkts/s", "SYN Flag Cnt", "RST Flag Cnt", "FIN Flag Cnt", "Pkt Len Mean", "Flow Duration"]


@modelled("q6_dataset_comparison")
def _(s, d):
    return ST.dataset_comparison(*classes(s, d), "flow_id", RAW_FEATURES)["sweep"]


@modelled("q7_all_feature_run")
def _(s, d):
    base = s.createDataFrame([("precision", 0.695), ("recall", 0.555), ("f1", 0.617), ("accuracy", 0.656)], "metric string, value double")
    return ST.all_feature_run(*classes(s, d), "flow_id", base)["delta"]


@modelled("q8_rigorous_eval")
def _(s, d):
    return ST.rigorous_eval(*classes(s, d), "flow_id")["metrics"]


@modelled("q9_kdd_eval")
def _(s, d):
    k = view(s, d, "kdd_lite")
    return ST.kdd_eval(k.where("event_id % 2 = 1"), k.where("event_id % 2 = 0"), "event_id")


@modelled("q10_algorithm_comparison")
def _(s, d):
    return ST.algorithm_comparison(*classes(s, d), "flow_id")


def judged_sql(models: list[str], per_class: int, fractions: tuple[float, ...], sets: dict[str, str]) -> str:
    """Rows of each class that every model is judged on, by evaluation set (an expression of all, of the sample, and of cuts c1, c2)."""
    cuts = ", ".join(f"CAST(round(m * CAST({f} AS DOUBLE)) AS BIGINT) AS c{i + 1}" for i, f in enumerate(fractions))
    parts = " UNION ALL ".join(f"SELECT '{name}' AS eval_set, y, {rows} AS n FROM k" for name, rows in sets.items())
    names = ", ".join(f"('{m}')" for m in models)
    return oracle(["raw_flows"], f"""c AS (SELECT label AS y, count(*) AS n, least(count(*), {per_class}) AS m FROM raw_flows GROUP BY label), k AS (SELECT *, {cuts} FROM c), e AS ({parts})
SELECT model, eval_set, CAST(sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS BIGINT) AS normal, CAST(sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS BIGINT) AS attack
FROM e, (SELECT * FROM (VALUES {names}) AS t(model)) GROUP BY model, eval_set""")


@exact("q8_judged_rows", judged_sql(list(ALL_MODELS), 10_000, (0.6, 0.8), {"test": "c2 - c1", "unseen": "n - c2"}))
def _(s, d):
    return cells(ST.rigorous_eval(*classes(s, d), "flow_id")["metrics"], ["model", "eval_set"])


@exact("q8_fold_rows", oracle(["raw_flows"], """t AS (SELECT label, CAST(round(least(count(*), 10000) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS m FROM raw_flows GROUP BY label)
SELECT f AS fold, CAST(sum(CASE WHEN label = 0 THEN (m - f + 4) // 5 ELSE 0 END) AS BIGINT) AS normal, CAST(sum(CASE WHEN label = 1 THEN (m - f + 4) // 5 ELSE 0 END) AS BIGINT) AS attack
FROM t, (SELECT CAST(unnest(range(5)) AS INT) AS f) GROUP BY f"""))
def _(s, d):
    return cells(ST.rigorous_eval(*classes(s, d), "flow_id")["folds"], ["fold"])


@modelled("q8_top_features")
def _(s, d):
    return ST.rigorous_eval(*classes(s, d), "flow_id")["top_features"]


@exact("q10_judged_rows", judged_sql([ISOLATION, ADABOOST, BOOSTED, FOREST], 10_000, (0.8,), {"test": "m - c1", "unseen": "n - m"}))
def _(s, d):
    return cells(ST.algorithm_comparison(*classes(s, d), "flow_id"), ["model", "eval_set"])


@modelled("q5_best_alerts")
def _(s, d):
    return ST.flow_report(*classes(s, d), "flow_id")["alerts"].select("flow_id", "timestamp", "type", "severity", "if_score")


@modelled("q5_series")
def _(s, d):
    return ST.flow_report(*classes(s, d), "flow_id")["series"]


@exact("q5_judged_rows", oracle(["raw_flows"], "SELECT CAST(sum(1 - label) AS BIGINT) AS normal, CAST(sum(label) AS BIGINT) AS attack FROM raw_flows"))
def _(s, d):
    return cells(ST.flow_report(*classes(s, d), "flow_id")["confusion"], [])


def study_tables(s, d):
    return ST.dataset_comparison(*classes(s, d), "flow_id", RAW_FEATURES)


CLEAN_SQL = "v AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, label AS class, CASE WHEN {q} IS NULL OR isnan({q}) OR abs({q}) = CAST('inf' AS DOUBLE) THEN 0 ELSE greatest({q}, 0) END AS v FROM raw_flows"""
    for f in RAW_FEATURES for q in [f"CAST({[c for c, h in FLOW_HEADERS.items() if h == f][0]} AS DOUBLE)"]
) + ")"


@exact("q6_cohens_d", oracle(["raw_flows"], CLEAN_SQL + """,
k AS (SELECT feature, avg(v) FILTER (class = 1) AS m1, avg(v) FILTER (class = 0) AS m0, stddev_pop(v) FILTER (class = 1) AS s1, stddev_pop(v) FILTER (class = 0) AS s0 FROM v GROUP BY feature)
SELECT feature, (m1 - m0) / (sqrt((s1 * s1 + s0 * s0) / 2) + 1e-9) AS cohens_d FROM k"""))
def _(s, d):
    return study_tables(s, d)["cohens_d"].select("feature", "cohens_d")


for table_name in ("roc", "pr", "kde"):

    @modelled(f"q6_{table_name}")
    def _(s, d, table_name=table_name):
        return study_tables(s, d)[table_name]


@modelled("q11_threat_report")
def _(s, d):
    full, _ = TR.threat_report_data(traffic(s, d)[1])
    return full.select("timestamp", "src_ip", "type", "severity", "context_type", "mitre", F.size("cves").alias("n_cves"))
