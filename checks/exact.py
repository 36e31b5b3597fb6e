"""Queries with an exact SQL counterpart: ``EXACT[name] = (spark query, DuckDB SQL)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, raw_flows, table, view
from flowarden.functions import scalars as S
from flowarden.operators import alerts as A
from flowarden.operators import evaluate as E
from flowarden.operators import features as X
from flowarden.operators import flows as FL
from flowarden.operators import history as H
from flowarden.operators import sampling as U
from flowarden.operators import threats as TC
from flowarden.operators import windows as W
from flowarden.sources import tables as SRC
from flowarden.streaming import packets as P

EXACT: dict = {}


def exact(name: str, sql: str):
    def register(fn):
        EXACT[name] = (fn, sql)
        return fn

    return register


# ---- shared SQL fragments ------------------------------------------------------------------------------
BUCKET = "time_bucket(INTERVAL '{}', {}, TIMESTAMP '1970-01-01')"
W6 = BUCKET.format("6 hours", "timestamp")
INF = "CAST('Infinity' AS DOUBLE)"
CORE_NAMES = S.CORE_FEATURES
RAW_EXPR = {
    "flow_byts_s": "greatest(coalesce(flow_byts_per_s, 0), 0)",
    "flow_pkts_s": "greatest(coalesce(flow_pkts_per_s, 0), 0)",
    "fwd_bytes": "coalesce(totlen_fwd_pkts, 0)",
    "bwd_bytes": "coalesce(totlen_bwd_pkts, 0)",
    "total_pkts": "coalesce(tot_fwd_pkts, 0) + coalesce(tot_bwd_pkts, 0)",
    "syn_flag": "coalesce(syn_flag_cnt, 0)",
    "rst_flag": "coalesce(rst_flag_cnt, 0)",
    "fin_flag": "coalesce(fin_flag_cnt, 0)",
    "flow_duration_s": "coalesce(flow_duration, 0) / CAST(1000000 AS DOUBLE)",
    "pkt_len_mean": "coalesce(pkt_len_mean, 0)",
}
CORE = "core AS (SELECT flow_id, label AS y, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in RAW_EXPR.items()) + " FROM raw_flows)"
# infinite rates read as 0
FIN = "fin AS (SELECT flow_id, y, " + ", ".join(f"CASE WHEN abs({c}) = {INF} THEN 0 ELSE {c} END AS {c}" for c in CORE_NAMES) + " FROM core)"
SCALED = (
    "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in CORE_NAMES)
    + " FROM fin), scaled AS (SELECT flow_id, y, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in CORE_NAMES) + " FROM fin, st)"
)
WINFEAT = f"""
wf0 AS (SELECT {W6} AS "window", src_ip, count(bytes) AS n_packets, CAST(sum(bytes) AS BIGINT) AS n_bytes, avg(bytes) AS avg_bytes,
  coalesce(stddev_samp(bytes), 0) AS std_bytes, count(DISTINCT dst_port) AS n_dst_ports, count(DISTINCT dst_ip) AS n_dst_ips,
  CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(hour(min(timestamp)) AS INT) AS hour
  FROM conn_log GROUP BY 1, 2),
wf AS (SELECT *, n_failed / CAST(n_packets AS DOUBLE) AS failed_ratio, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos FROM wf0)"""
FLOWS5 = """
pk AS (SELECT *, src_ip < dst_ip AS fwd, CASE WHEN protocol = 'TCP' THEN tcp_flags ELSE 0 END AS fl FROM packets),
kx AS (SELECT {extra}CASE WHEN fwd THEN src_ip ELSE dst_ip END AS src_ip, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS dst_ip,
  {keys} time, length, fwd, CASE WHEN (fl & 2) <> 0 THEN 1 ELSE 0 END AS syn, CASE WHEN (fl & 4) <> 0 THEN 1 ELSE 0 END AS rst,
  CASE WHEN (fl & 1) <> 0 THEN 1 ELSE 0 END AS fin FROM pk),
ag AS (SELECT {group}, max(time) - min(time) AS span, CAST(sum(CASE WHEN fwd THEN length ELSE 0 END) AS DOUBLE) AS fwd_bytes,
  CAST(sum(CASE WHEN fwd THEN 0 ELSE length END) AS DOUBLE) AS bwd_bytes, count(*) AS total_pkts, CAST(sum(syn) AS BIGINT) AS syn_flag,
  CAST(sum(rst) AS BIGINT) AS rst_flag, CAST(sum(fin) AS BIGINT) AS fin_flag FROM kx GROUP BY {group}),
fl AS (SELECT {group}, (fwd_bytes + bwd_bytes) / dur AS flow_byts_s, total_pkts / dur AS flow_pkts_s, fwd_bytes, bwd_bytes, total_pkts,
  syn_flag, rst_flag, fin_flag, dur AS flow_duration_s, (fwd_bytes + bwd_bytes) / total_pkts AS pkt_len_mean
  FROM (SELECT *, CASE WHEN span > 0 THEN span ELSE CAST(0.0001 AS DOUBLE) END AS dur FROM ag))"""
PORTS5 = (
    "CASE WHEN fwd THEN src_port ELSE dst_port END AS src_port, CASE WHEN fwd THEN dst_port ELSE src_port END AS dst_port, "
    "CASE WHEN protocol IN ('TCP', 'UDP') THEN protocol ELSE 'Other' END AS protocol,"
)
FIVE = FLOWS5.format(extra="", keys=PORTS5, group="src_ip, dst_ip, src_port, dst_port, protocol")
THREE = FLOWS5.format(extra="", keys="dst_port,", group="src_ip, dst_ip, dst_port")
TS30 = BUCKET.format("30 seconds", "make_timestamp(CAST(round(time * 1000000) AS BIGINT))") + ' AS "window", '
FIVE_W = FLOWS5.format(extra=TS30, keys=PORTS5, group='"window", src_ip, dst_ip, src_port, dst_port, protocol')
THREE_W = FLOWS5.format(extra=TS30, keys="dst_port,", group='"window", src_ip, dst_ip, dst_port')
FLOW_COLS = "flow_byts_s, flow_pkts_s, fwd_bytes, bwd_bytes, total_pkts, syn_flag, rst_flag, fin_flag, flow_duration_s, pkt_len_mean"
# a stand-in for the trained model, so that what follows it stays exact
SURROGATE_SQL = (
    "least(total_pkts / CAST(10 AS DOUBLE), 1) AS prob, CASE WHEN total_pkts >= 8 THEN 1 ELSE 0 END AS is_anomaly, "
    "(fwd_bytes - bwd_bytes) / (fwd_bytes + bwd_bytes + 1) AS if_score"
)
THREAT_SQL = """CASE WHEN syn_flag > 5 THEN 'Port Scan / Recon' WHEN total_pkts > 1000 OR flow_byts_s > 5000000 THEN 'DDoS Volumetric'
  WHEN fwd_bytes > 1000000 AND syn_flag < 2 THEN 'Data Exfiltration' WHEN pkt_len_mean < 80 AND total_pkts > 50 THEN 'Brute Force'
  ELSE 'Suspicious Traffic' END"""
SEV_SQL = """CASE WHEN syn_flag > 5 THEN 'High' WHEN total_pkts > 1000 OR flow_byts_s > 5000000 THEN 'Critical'
  WHEN fwd_bytes > 1000000 AND syn_flag < 2 THEN 'High' ELSE 'Medium' END"""
CONFUSION = """cm AS (SELECT CAST(sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored_flows)"""
CURVE = """g AS (SELECT -if_score AS threshold, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored_flows GROUP BY 1),
cu AS (SELECT threshold, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS np, CAST(sum(neg) OVER () AS DOUBLE) AS nn FROM g WINDOW w AS (ORDER BY threshold DESC)),
pt AS (SELECT *, tp / (tp + fp) AS prec, tp / np AS rec, fp / nn AS fpr, coalesce(lag(tp / (tp + fp)) OVER (ORDER BY threshold DESC), 1) AS prev,
  coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY threshold DESC), 0) AS fp0 FROM cu)"""


def surrogate(flows):
    n = F.col("total_pkts")
    return flows.withColumns(
        {
            "prob": F.least(n / F.lit(10.0), F.lit(1.0)),
            "is_anomaly": F.when(n >= 8, 1).otherwise(0),
            "if_score": (F.col("fwd_bytes") - F.col("bwd_bytes")) / (F.col("fwd_bytes") + F.col("bwd_bytes") + 1),
        }
    )


def conn(s, d):
    return view(s, d, "conn_log")


def scored(s, d):
    return view(s, d, "scored_flows").withColumn("score", -F.col("if_score"))


def core(s, d, clip="rates"):
    return X.featurise_flows(raw_flows(s, d).withColumn("y", F.col("Label")), clip, keep=["flow_id", "y"])


def fin(s, d):
    c = core(s, d)
    return c.withColumns({f: S.clean_inf(f) for f in CORE_NAMES})


def listed(s, d):
    """attributions as one ordered list per row id."""
    a = view(s, d, "attributions")
    item = F.struct("feature", S.display_name("feature").alias("display_name"), "impact")
    rows = a.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", item.alias("v")))).alias("x"))
    return rows.select("id", F.transform("x", lambda x: x["v"]).alias("contributions"))


# ---- sources and sinks ---------------------------------------------------------------------------------
@exact("s6_profile", "SELECT count(*) AS num_rows, 11 AS num_cols FROM lineitem")
def _(s, d):
    return SRC.profile(table(s, d, "lineitem"))


@exact("s9_export_history", oracle(["history"], "SELECT " + ", ".join(H.EXPORT_COLUMNS) + " FROM history"))
def _(s, d):
    return H.export_columns(view(s, d, "history").withColumn("shap_explanation", F.lit("[]")))


@exact("s11_packet_payload", oracle(["payloads"], """SELECT event_id, coalesce(time, 1700000000.0::DOUBLE) AS time, coalesce(src_ip, '192.168.1.100') AS src_ip,
 coalesce(dst_ip, '10.0.0.1') AS dst_ip, coalesce(src_port, 1234) AS src_port, coalesce(dst_port, 80) AS dst_port, upper(coalesce(protocol, 'TCP')) AS protocol,
 coalesce(length, 64) AS length, (CASE WHEN syn_flag <> 0 THEN 2 ELSE 0 END) | (CASE WHEN coalesce(rst_flag, 0) <> 0 THEN 4 ELSE 0 END) | (CASE WHEN fin_flag <> 0 THEN 1 ELSE 0 END) AS tcp_flags FROM payloads"""))
def _(s, d):
    return P.normalise_payload(view(s, d, "payloads"), F.timestamp_seconds(F.lit(1700000000)), keep=["event_id"])


# ---- projections and scalars ---------------------------------------------------------------------------
@exact("p1_featurise_flows", oracle(["raw_flows"], CORE + " SELECT * FROM core"))
def _(s, d):
    return core(s, d)


@exact("p1_featurise_flows_clip_all", oracle(["raw_flows"], CORE + " SELECT flow_id, y, " + ", ".join(f"greatest({c}, 0) AS {c}" for c in CORE_NAMES) + " FROM core"))
def _(s, d):
    return core(s, d, "all")


@exact("p2_resolve_columns", oracle(["raw_flows"], "SELECT flow_id, coalesce(flow_byts_per_s, 0) AS flow_byts_s, 0.0::DOUBLE AS flow_pkts_s, totlen_fwd_pkts AS fwd_bytes, totlen_bwd_pkts AS bwd_bytes, "
    "tot_fwd_pkts + tot_bwd_pkts AS total_pkts, syn_flag_cnt AS syn_flag, rst_flag_cnt AS rst_flag, fin_flag_cnt AS fin_flag, flow_duration / CAST(1000000 AS DOUBLE) AS flow_duration_s, pkt_len_mean FROM raw_flows"))
def _(s, d):
    mixed = raw_flows(s, d).drop("Flow Pkts/s").withColumnsRenamed({"SYN Flag Cnt": "syn_flag", "Tot Fwd Pkts": "total_fwd_pkts"})
    return X.resolve_columns(mixed, keep=["flow_id"])


@exact("p3_to_numeric", "SELECT event_id, coalesce(TRY_CAST(props[7:] AS DOUBLE), CASE WHEN event_id % 2 = 0 THEN value END, 0) AS n FROM events")
def _(s, d):
    e = table(s, d, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.col("props"))
    return e.select("event_id", S.to_numeric(text, 0).alias("n"))


@exact("p4_clean_inf", oracle(["raw_flows"], f"SELECT flow_id, coalesce(CASE WHEN abs(flow_byts_per_s) = {INF} THEN NULL ELSE flow_byts_per_s END, 0) AS byts, "
    f"greatest(coalesce(CASE WHEN abs(flow_pkts_per_s) = {INF} THEN NULL ELSE flow_pkts_per_s END, 0), 0) AS pkts FROM raw_flows"))
def _(s, d):
    return view(s, d, "raw_flows").select("flow_id", S.clean_inf("flow_byts_per_s").alias("byts"), S.clean_inf("flow_pkts_per_s", 0, True).alias("pkts"))


IMPUTE = ["flow_byts_per_s", "flow_pkts_per_s", "pkt_len_mean"]
FITTED = "fin_flag_cnt = 1"  # the rows the statistics come from


@exact("p5_median_imputer", oracle(["raw_flows"], "f AS (SELECT flow_id, fin_flag_cnt, " + ", ".join(f"CASE WHEN abs({c}) = {INF} THEN NULL ELSE {c} END AS {c}" for c in IMPUTE)
    + f" FROM raw_flows), m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in IMPUTE) + f" FROM f WHERE {FITTED}) SELECT flow_id, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in IMPUTE) + " FROM f, m"))
def _(s, d):
    r = view(s, d, "raw_flows").select("flow_id", "fin_flag_cnt", *IMPUTE)
    return X.MedianImputer.fit(r.where(FITTED), IMPUTE).transform(r).drop("fin_flag_cnt")


SKEWS = ["totlen_fwd_pkts", "totlen_bwd_pkts", "rst_flag_cnt", "syn_flag_cnt"]


@exact("p6_skew_log1p", oracle(["raw_flows"], "k AS (SELECT " + ", ".join(f"skewness({c}) AS k_{c}" for c in SKEWS) + " FROM raw_flows) SELECT flow_id, "
    + ", ".join(f"CASE WHEN k_{c} > 2 THEN ln(1 + greatest({c}, 0)) ELSE {c} END AS {c}, k_{c}" for c in SKEWS) + " FROM raw_flows, k"))
def _(s, d):
    r = view(s, d, "raw_flows").select("flow_id", *SKEWS)
    step = X.SkewLog1p.fit(r, SKEWS)
    return step.transform(r).withColumns({f"k_{c}": F.lit(v) for c, v in step.skews.items()})


@exact("p7_drop_zero_variance", oracle(["raw_flows"], "SELECT flow_id, syn_flag_cnt, rst_flag_cnt, pkt_len_mean FROM raw_flows"))
def _(s, d):
    r = view(s, d, "raw_flows").select("flow_id", "syn_flag_cnt", "rst_flag_cnt", "pkt_len_mean", "urg_flag_cnt")
    return X.drop_zero_variance(r, [c for c in r.columns if c != "flow_id"])


@exact("p8_standard_scale", oracle(["raw_flows"], f"{CORE}, {FIN}, {SCALED} SELECT * FROM scaled"))
def _(s, d):
    f = fin(s, d)
    return X.StandardScale.fit(f, CORE_NAMES).transform(f)


@exact("p9_one_hot_aligned", oracle(["kdd_lite"], "SELECT event_id, src_bytes, "
    + ", ".join(f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{v}\"" for c, vs in (("protocol_type", ("icmp", "tcp", "udp")), ("service", [f"svc{i}" for i in range(5)]), ("flag", ("REJ", "SF"))) for v in vs)
    + " FROM kdd_lite"))
def _(s, d):
    k = view(s, d, "kdd_lite").select("event_id", "src_bytes", "protocol_type", "service", "flag")
    train, test = X.one_hot_aligned(k.where("event_id % 2 = 0"), k.where("event_id % 2 = 1"), SRC.KDD_CATEGORICAL)
    return train.unionByName(test)


@exact("p10_binary_label", oracle(["kdd_lite"], "SELECT event_id, CASE WHEN lower(trim(label)) <> 'normal' THEN 1 ELSE 0 END AS y, CASE WHEN lower(trim(label)) IN ('1', 'attack', 'anomaly', 'malicious') THEN 1 ELSE 0 END AS words FROM kdd_lite"))
def _(s, d):
    k = view(s, d, "kdd_lite")
    return X.with_binary_label(X.with_binary_label(k, "not_normal"), "attack_words", name="words").select("event_id", "y", "words")


@exact("p11_cyclic_hour", oracle(["conn_log"], "SELECT event_id, CAST(hour(timestamp) AS INT) AS hour, sin(2 * pi() * hour(timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24) AS hour_cos FROM conn_log"))
def _(s, d):
    return W.with_cyclic_hour(conn(s, d)).select("event_id", "hour", "hour_sin", "hour_cos")


@exact("p12_failed_ratio", oracle(["conn_log"], "SELECT src_ip, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS failed_ratio FROM conn_log GROUP BY src_ip"))
def _(s, d):
    return conn(s, d).groupBy("src_ip").agg(F.avg(S.failed_flag()).alias("failed_ratio"))


PROTO_CASE = "CASE event_id % 8 WHEN 0 THEN '6' WHEN 1 THEN '17.0' WHEN 2 THEN '1' WHEN 3 THEN 'tcp' WHEN 4 THEN '6.0' WHEN 5 THEN '17' WHEN 6 THEN 'Icmp' ELSE '1.0' END"


@exact("p13_normalise_protocol", f"SELECT event_id, CASE WHEN upper(p) IN ('6', '6.0') THEN 'TCP' WHEN upper(p) IN ('17', '17.0') THEN 'UDP' WHEN upper(p) IN ('1', '1.0') THEN 'ICMP' ELSE upper(p) END AS protocol FROM (SELECT event_id, {PROTO_CASE} AS p FROM events)")
def _(s, d):
    return table(s, d, "events").select("event_id", S.normalise_protocol(F.expr(PROTO_CASE)).alias("protocol"))


@exact("p14_decode_tcp_flags", oracle(["packets"], "SELECT packet_id, CASE WHEN protocol = 'TCP' AND (tcp_flags & 2) <> 0 THEN 1 ELSE 0 END AS syn, CASE WHEN protocol = 'TCP' AND (tcp_flags & 4) <> 0 THEN 1 ELSE 0 END AS rst, CASE WHEN protocol = 'TCP' AND (tcp_flags & 1) <> 0 THEN 1 ELSE 0 END AS fin FROM packets"))
def _(s, d):
    return view(s, d, "packets").withColumns(S.tcp_flag_bits()).select("packet_id", "syn", "rst", "fin")


@exact("p15_threat_type", oracle(["raw_flows"], f"{CORE} SELECT flow_id, CASE WHEN y = 0 THEN 'Normal' ELSE {THREAT_SQL} END AS attack_type, CASE WHEN y = 0 THEN 'Low' ELSE {SEV_SQL} END AS severity FROM core"))
def _(s, d):
    return core(s, d).withColumns(S.threat_type(F.col("y") == 1)).select("flow_id", "attack_type", "severity")


@exact("p16_verdict", oracle(["scored_flows"], "SELECT flow_id, CASE WHEN pred = 1 AND prob >= 0.7 THEN 1 ELSE 0 END AS is_anomaly, round(CASE WHEN pred = 1 AND prob >= 0.7 THEN prob ELSE 1 - prob END * 100, 2) AS confidence FROM scored_flows"))
def _(s, d):
    return view(s, d, "scored_flows").withColumns(S.verdict("pred", "prob", 0.7)).select("flow_id", "is_anomaly", "confidence")


# surrogate window score: the lowest 10 % of it count as flagged
WSCORE = "-(CAST((n_bytes * 7 + n_dst_ports * 13) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE))"
TRIAGE = WINFEAT + f""",
ws AS (SELECT *, {WSCORE} AS if_score FROM wf),
th AS (SELECT quantile_cont(if_score, CAST(0.1 AS DOUBLE)) AS t FROM ws),
fl AS (SELECT ws.*, CASE WHEN if_score < t THEN -1 ELSE 1 END AS if_label FROM ws, th),
bs AS (SELECT avg(n_dst_ports) AS ports_mean, stddev_samp(n_dst_ports) AS ports_std, avg(n_bytes) AS bytes_mean, stddev_samp(n_bytes) AS bytes_std,
  avg(failed_ratio) AS failed_mean, stddev_samp(failed_ratio) AS failed_std, avg(avg_bytes) AS avg_mean, stddev_samp(avg_bytes) AS avg_std FROM fl WHERE if_label = 1),
z AS (SELECT fl.*, (n_dst_ports - ports_mean) / greatest(ports_std, 1e-9) AS zp, (n_bytes - bytes_mean) / greatest(bytes_std, 1e-9) AS zb,
  (failed_ratio - failed_mean) / greatest(failed_std, 1e-9) AS zf, (avg_bytes - avg_mean) / greatest(avg_std, 1e-9) AS za, hour BETWEEN 0 AND 5 AS night FROM fl, bs WHERE if_label = -1),
lab AS (SELECT "window" AS timestamp, src_ip,
  CASE WHEN zp > {{p}} THEN 'Port Scan' WHEN zf > {{f}} THEN 'Brute Force' WHEN zb > {{b}} AND za > 2 THEN 'Data Exfiltration' WHEN zb > {{b}} AND night THEN 'Night Activity'
       WHEN zb > {{b}} THEN 'Traffic Spike' WHEN night THEN 'Night Activity' ELSE 'Unknown' END AS type,
  CASE WHEN zp > {{p}} OR zf > {{f}} THEN 'HIGH' WHEN zb > {{b}} AND (za > 2 OR night OR zb > 5) THEN 'CRITICAL' WHEN zb > {{b}} THEN 'HIGH' WHEN night THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  if_score, n_bytes, n_packets, n_dst_ports, failed_ratio, hour FROM z)"""
TRIAGE = TRIAGE.format(p=3, f=2.5, b=3)


def window_scores(s, d, window="6 hours"):
    w = W.window_features(conn(s, d), window)
    return w.withColumn("if_score", -(((F.col("n_bytes") * 7 + F.col("n_dst_ports") * 13) % 1000).cast("double") / F.lit(1000.0)))


def triage_rows(s, d):
    from flowarden.plans.triage import label_windows

    return label_windows(E.flag_by_contamination(window_scores(s, d), 0.1))


@exact("p17_classify_window", oracle(["conn_log"], TRIAGE + ' SELECT * FROM lab'))
def _(s, d):
    return triage_rows(s, d)


FB = ["flow_byts_s", "flow_pkts_s", "fwd_bytes", "rst_flag", "syn_flag", "flow_duration_s"]
FLOWLAB = f"""bs AS (SELECT {", ".join(f"avg({c}) AS m_{c}, greatest(stddev_samp({c}), 1e-9) AS s_{c}" for c in FB)} FROM fin WHERE y = 0),
z AS (SELECT fin.*, m_flow_pkts_s, {", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in FB)} FROM fin, bs WHERE y = 1),
lab AS (SELECT flow_id, CASE WHEN z_flow_byts_s > 4 OR z_flow_pkts_s > 4 THEN 'DDoS / Flood' WHEN z_rst_flag > 3 AND z_syn_flag > 1 THEN 'Port Scan'
  WHEN z_rst_flag > 3 AND total_pkts < m_flow_pkts_s THEN 'Brute Force' WHEN z_fwd_bytes > 3 AND z_flow_duration_s > 1 THEN 'Data Exfiltration'
  WHEN z_flow_duration_s > 3 AND z_flow_byts_s < 0 THEN 'Botnet C&C' ELSE 'Unknown' END AS type,
  CASE WHEN z_flow_byts_s > 4 OR z_flow_pkts_s > 4 THEN 'CRITICAL' WHEN z_rst_flag > 3 AND z_syn_flag > 1 THEN 'HIGH'
  WHEN z_rst_flag > 3 AND total_pkts < m_flow_pkts_s THEN 'HIGH' WHEN z_fwd_bytes > 3 AND z_flow_duration_s > 1 THEN 'CRITICAL'
  WHEN z_flow_duration_s > 3 AND z_flow_byts_s < 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM z)"""


@exact("p18_classify_flow", oracle(["raw_flows"], f"{CORE}, {FIN}, {FLOWLAB} SELECT * FROM lab"))
def _(s, d):
    f = fin(s, d).withColumn("if_label", F.when(F.col("y") == 1, -1).otherwise(1))
    stats = A.baseline_stats(f, S.FLOW_BASELINE)
    return A.with_baseline(f.where("if_label = -1"), stats).withColumns(S.classify_flow()).select("flow_id", "type", "severity")


@exact("p19_fallback_identity", oracle(["packets"], "SELECT packet_id, src_ip, '10.0.0.1' AS dst_ip, CASE WHEN packet_id % 3 = 0 THEN 0 ELSE dst_port END AS dst_port, protocol FROM packets"))
def _(s, d):
    p = view(s, d, "packets").select(
        "packet_id", F.col("src_ip").alias("Source IP"), F.when(F.col("packet_id") % 3 != 0, F.col("dst_port")).alias("dst_port"), F.col("protocol").alias("Protocol")
    )
    return p.select("packet_id", *[c.alias(n) for n, c in S.fallback_identity(p.columns).items()])


@exact("p20_packet_filter", oracle(["packets"], "SELECT packet_id, src_ip, dst_ip, src_port, dst_port FROM packets WHERE (src_ip = '10.0.0.1' OR dst_ip = '10.0.0.1') AND (src_port = 83 OR dst_port = 83)"))
def _(s, d):
    return view(s, d, "packets").where(S.packet_filter("10.0.0.1", 83)).select("packet_id", "src_ip", "dst_ip", "src_port", "dst_port")


@exact("p21_select_features", oracle(["raw_flows"], 'SELECT flow_id, tot_fwd_pkts AS "Tot Fwd Pkts", tot_bwd_pkts AS "Tot Bwd Pkts" FROM raw_flows'))
def _(s, d):
    r = raw_flows(s, d).select("flow_id", "Tot Fwd Pkts", "Tot Bwd Pkts", "Label").withColumn("true_label", F.col("Label"))
    return X.select_features(r)


@exact("p22_flow_details", oracle(["packets"], FIVE + ", un AS (UNPIVOT (SELECT src_ip, dst_ip, src_port, dst_port, protocol, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CORE_NAMES) + " FROM fl) ON " + ", ".join(CORE_NAMES) + " INTO NAME feature VALUE v) SELECT src_ip, dst_ip, src_port, dst_port, protocol, feature, round(v, 4) AS value FROM un"))
def _(s, d):
    f = FL.assemble_flows(view(s, d, "packets"))
    return f.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.explode(S.flow_details()).alias("feature", "value"))


NAMES_SQL = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.DISPLAY_NAMES.items() if k != "rst_flag") + " ELSE feature END"


@exact("p23_attribution_json", oracle(["attributions"], "SELECT id, feature, " + NAMES_SQL.replace("WHEN 'fin_flag'", "WHEN 'rst_flag' THEN 'RST Flag Count' WHEN 'fin_flag'") + " AS display_name, impact FROM attributions"))
def _(s, d):
    text = listed(s, d).select("id", S.attribution_to_json("contributions").alias("j"))
    return text.select("id", F.inline(S.attribution_from_json("j")))


TOP4 = """rk AS (SELECT id, dn, impact, row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, idx) AS r FROM (SELECT *, {names} AS dn FROM attributions) a WHERE impact > 0.01),
tx AS (SELECT id, max(r) AS n, max(CASE WHEN r = 1 THEN dn END) AS a, max(CASE WHEN r = 2 THEN dn END) AS b, max(CASE WHEN r = 3 THEN dn END) AS c, max(CASE WHEN r = 4 THEN dn END) AS e FROM rk WHERE r <= 4 GROUP BY id),
se AS (SELECT ids.id, CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN a WHEN n = 2 THEN a || ', and ' || b WHEN n = 3 THEN a || ', ' || b || ', and ' || c ELSE a || ', ' || b || ', ' || c || ', and ' || e END AS t
  FROM (SELECT DISTINCT id FROM attributions) ids LEFT JOIN tx ON ids.id = tx.id)"""
FULL_NAMES = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.DISPLAY_NAMES.items()) + " ELSE feature END"
TOP4 = TOP4.format(names=FULL_NAMES)


@exact("p24_explanation_text", oracle(["attributions"], TOP4 + f" SELECT id, coalesce('{S.FLOW_REASON[0]}' || t || '{S.FLOW_REASON[1]}', '{S.SUBTLE_TEXT}') AS text FROM se"))
def _(s, d):
    return listed(s, d).select("id", S.explanation_text("contributions").alias("text"))


@exact("p25_relative_impact", oracle(["attributions"], "SELECT id, idx - 1 AS pos, least(abs(impact) / greatest(max(abs(impact)) OVER (PARTITION BY id), 0.01), 1) * 100 AS width FROM attributions"))
def _(s, d):
    return listed(s, d).select("id", F.posexplode(S.relative_impact("contributions")).alias("pos", "width"))


@exact("p26_synth_timestamps", oracle(["raw_flows"], "n AS (SELECT flow_id, row_number() OVER (ORDER BY flow_id) - 1 AS i, count(*) OVER () AS c FROM raw_flows) SELECT flow_id, TIMESTAMP '2024-01-15 00:00:00' + to_microseconds(CAST(floor(CAST(i AS DOUBLE) * (CAST(86400000000 AS DOUBLE) / c)) AS BIGINT)) AS timestamp FROM n"))
def _(s, d):
    return X.synth_timestamps(view(s, d, "raw_flows").select("flow_id"), ["flow_id"])


@exact("p27_serve_anomalies", oracle(["conn_log"], TRIAGE + " SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, src_ip, type, severity, round(if_score, 4) AS if_score, n_bytes, n_packets, n_dst_ports, round(failed_ratio, 4) AS failed_ratio, n_bytes / CAST(1024 AS DOUBLE) AS kb FROM lab"))
def _(s, d):
    return W.serve_anomalies(triage_rows(s, d))


@exact("p28_display_name", oracle(["attributions"], f"SELECT DISTINCT f AS feature, {FULL_NAMES.replace('feature', 'f')} AS display_name FROM (SELECT CASE WHEN id % 5 = 0 THEN feature || '_raw' ELSE feature END AS f FROM attributions) x"))
def _(s, d):
    f = F.when(F.col("id") % 5 == 0, F.concat("feature", F.lit("_raw"))).otherwise(F.col("feature"))
    return view(s, d, "attributions").select(f.alias("feature")).distinct().withColumn("display_name", S.display_name("feature"))


@exact("p29_flag_to_label", oracle(["scored_flows"], "SELECT flow_id, CASE WHEN if_score < -0.4 THEN 1 ELSE 0 END AS label FROM scored_flows"))
def _(s, d):
    flag = F.when(F.col("if_score") < -0.4, -1).otherwise(1)
    return view(s, d, "scored_flows").select("flow_id", S.flag_to_label(flag).alias("label"))


# ---- joins ---------------------------------------------------------------------------------------------
def _sql_text(v):
    return "'" + v.replace("'", "''") + "'"


CONTEXT_SQL = "ctx(attack_type, mitre, description, n_cves, n_mitigations, top) AS (VALUES " + ", ".join(
    f"({_sql_text(t)}, {_sql_text(m)}, {_sql_text(de)}, {len(cv)}, {len(mi)}, {'CAST(%s AS DOUBLE)' % max(c[2] for c in cv) if cv else 'NULL'})"
    for t, de, m, cv, mi in TC.THREAT_CONTEXT
) + ")"


@exact("j1_enrich_threats", oracle(["anomaly_rows"], CONTEXT_SQL + " SELECT a.event_id, a.type, c.attack_type AS context_type, c.mitre, c.description, c.n_cves, c.n_mitigations FROM anomaly_rows a JOIN ctx c ON c.attack_type = CASE WHEN a.type IN (SELECT attack_type FROM ctx) THEN a.type ELSE 'Unknown' END"))
def _(s, d):
    e = TC.enrich_threats(view(s, d, "anomaly_rows"))
    return e.select("event_id", "type", "context_type", "mitre", "description", F.size("cves").alias("n_cves"), F.size("mitigations").alias("n_mitigations"))


@exact("j2_explode_cves", oracle(["anomaly_rows"], "cve(attack_type, cve_id, cvss) AS (VALUES " + ", ".join(f"({_sql_text(t)}, {_sql_text(c[0])}, CAST({c[2]} AS DOUBLE))" for t, _d, _m, cv, _i in TC.THREAT_CONTEXT for c in cv)
    + ") SELECT a.type AS attack_type, cve_id, cvss, max(cvss) OVER (PARTITION BY a.type) AS max_cvss, n FROM (SELECT type, count(*) AS n FROM anomaly_rows GROUP BY type) a JOIN cve c ON c.attack_type = a.type"))
def _(s, d):
    counts = A.count_by(view(s, d, "anomaly_rows"), "type").withColumnRenamed("type", "attack_type")
    ctx = TC.threat_context(s)
    cves = TC.explode_cves(ctx).select("attack_type", "cve_id", "cvss")
    return counts.join(F.broadcast(cves), "attack_type").join(F.broadcast(TC.max_cvss(ctx)), "attack_type").select("attack_type", "cve_id", "cvss", "max_cvss", "n")


@exact("j3_with_baseline", oracle(["raw_flows"], f"{CORE}, {FIN}, bs AS (SELECT avg(syn_flag) AS syn_mean, stddev_samp(syn_flag) AS syn_std FROM fin WHERE y = 0) SELECT flow_id, syn_flag, syn_mean, syn_std FROM fin, bs WHERE y = 1"))
def _(s, d):
    f = fin(s, d).withColumn("if_label", F.when(F.col("y") == 1, -1).otherwise(1))
    return A.with_baseline(f.where("y = 1").select("flow_id", "syn_flag"), A.baseline_stats(f, {"syn": "syn_flag"}))


AUG = [*CORE_NAMES, "if_anomaly_score"]


STAND_IN = "(250 + (total_pkts * 31 + syn_flag * 7) % 300) / CAST(1000 AS DOUBLE)"  # score from the unscaled row


def _aug_sql(source):
    st = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in AUG)
    return (f"aug AS (SELECT f.*, {STAND_IN.replace('total_pkts', 'r.total_pkts').replace('syn_flag', 'r.syn_flag')} AS if_anomaly_score FROM {source} f JOIN fin r ON f.flow_id = r.flow_id), st2 AS (SELECT {st} FROM aug) "
            f"SELECT flow_id, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in AUG)} FROM aug, st2")


@exact("j4_augment_with_score", oracle(["raw_flows"], f"{CORE}, {FIN}, {SCALED}, {_aug_sql('scaled')}"))
def _(s, d):
    f = fin(s, d).withColumn("score", F.expr(STAND_IN))
    z = X.StandardScale.fit(f, CORE_NAMES).transform(f)
    return X.augment_with_score(z, CORE_NAMES, "score")[0].select("flow_id", *AUG)


@exact("j4_augment_unscaled", oracle(["raw_flows"], f"{CORE}, {FIN}, {_aug_sql('fin')}"))
def _(s, d):
    f = fin(s, d).withColumn("score", F.expr(STAND_IN))
    return X.augment_with_score(f, CORE_NAMES, "score")[0].select("flow_id", *AUG)


METRICS_SQL = CONFUSION + """, mt AS (SELECT (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall FROM cm), mf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM mt)"""
BASELINE_METRICS = {"precision": 0.695, "recall": 0.555, "f1": 0.617, "accuracy": 0.656}


@exact("j5_metric_delta", oracle(["scored_flows"], METRICS_SQL + ", lg AS (UNPIVOT mf ON precision, recall, f1, accuracy INTO NAME metric VALUE v) SELECT lg.metric, b.v AS baseline, lg.v AS \"new\", lg.v - b.v AS diff, CASE WHEN lg.v - b.v > 0 THEN '^' ELSE 'v' END AS direction FROM lg JOIN (VALUES "
    + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in BASELINE_METRICS.items()) + ") AS b(metric, v) ON b.metric = lg.metric"))
def _(s, d):
    m = E.binary_metrics(view(s, d, "scored_flows"))
    new = m.unpivot([], ["precision", "recall", "f1", "accuracy"], "metric", "value")
    return E.metric_delta(s.createDataFrame(list(BASELINE_METRICS.items()), "metric string, value double"), new)


@exact("j6_unused_rows", oracle(["raw_flows"], "s AS (SELECT flow_id FROM raw_flows WHERE label = 1 ORDER BY md5(flow_id || '|42'), flow_id LIMIT 500) SELECT flow_id, label FROM raw_flows WHERE flow_id NOT IN (SELECT flow_id FROM s)"))
def _(s, d):
    r = view(s, d, "raw_flows").select("flow_id", "label")
    return U.unused_rows(r, U.sample_n(r.where("label = 1"), 500, 42, "flow_id"), "flow_id")


@exact("j7_threshold_grid", oracle(["scored_flows"], "gr AS (SELECT CAST(t AS DOUBLE) / 10 AS t FROM range(1, 10) x(t)) SELECT t AS setting, t AS threshold, CAST(sum(CASE WHEN prob >= t AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN prob >= t AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN prob < t AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM scored_flows, gr GROUP BY t"))
def _(s, d):
    return E.threshold_grid(view(s, d, "scored_flows"), {t / 10: t / 10 for t in range(1, 10)}, "prob")


# ---- aggregations --------------------------------------------------------------------------------------
@exact("a1_window_features", oracle(["conn_log"], WINFEAT + " SELECT * FROM wf"))
def _(s, d):
    return W.window_features(conn(s, d), "6 hours")


@exact("a2_assemble_flows", oracle(["packets"], FIVE + " SELECT * FROM fl"))
def _(s, d):
    return FL.assemble_flows(view(s, d, "packets"))


@exact("a3_assemble_flows_3tuple", oracle(["packets"], THREE + " SELECT * FROM fl"))
def _(s, d):
    return FL.assemble_flows_3tuple(view(s, d, "packets"))


@exact("a4_resample", oracle(["conn_log"], f"""b AS (SELECT {BUCKET.format('5 minutes', 'timestamp')} AS bin, sum(bytes) / CAST(1024 AS DOUBLE) AS kb, count(bytes) AS conns, avg(bytes) AS avg_bytes, CAST(min(bytes) AS DOUBLE) AS min_bytes FROM conn_log GROUP BY 1),
 g AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL 5 MINUTE)) AS bin)
 SELECT g.bin, coalesce(kb, 0) AS kb, coalesce(conns, 0) AS conns, coalesce(avg_bytes, 0) AS avg_bytes, min_bytes FROM g LEFT JOIN b ON g.bin = b.bin"""))
def _(s, d):
    kb = F.col("bytes") / F.lit(1024.0)
    return W.resample(conn(s, d), "timestamp", "5 minutes", {"kb": ("sum", kb), "conns": ("count", "bytes"), "avg_bytes": ("mean", "bytes"), "min_bytes": ("min", F.col("bytes").cast("double"))})


@exact("a5_baseline_stats", oracle(["raw_flows"], f"{CORE}, {FIN} SELECT " + ", ".join(f"avg({c}) AS {n}_mean, stddev_samp({c}) AS {n}_std" for n, c in S.FLOW_BASELINE.items()) + " FROM fin WHERE y = 0"))
def _(s, d):
    return A.baseline_stats(fin(s, d).withColumn("if_label", F.when(F.col("y") == 1, -1).otherwise(1)), S.FLOW_BASELINE)


@exact("a6_count_by", oracle(["anomaly_rows"], "SELECT type, severity, count(*) AS n FROM anomaly_rows GROUP BY 1, 2"))
def _(s, d):
    return A.count_by(view(s, d, "anomaly_rows"), "type", "severity")


@exact("a6_known_unknown", oracle(["conn_log"], TRIAGE + " SELECT count(*) AS total, count(*) - count(CASE WHEN type = 'Unknown' THEN 1 END) AS known, count(CASE WHEN type = 'Unknown' THEN 1 END) AS unknown FROM lab"))
def _(s, d):
    return A.known_unknown(triage_rows(s, d))


@exact("a7_detection_summary", oracle(["scored_flows"], "SELECT count(*) AS total_flows, CAST(sum(pred) AS BIGINT) AS anomalies, CAST(count(*) - sum(pred) AS BIGINT) AS normal, CAST(sum(pred) AS DOUBLE) / count(*) * 100 AS threat_ratio, avg(prob) AS mean_prob, avg(if_score) AS mean_score FROM scored_flows"))
def _(s, d):
    return A.detection_summary(view(s, d, "scored_flows"), "pred")


@exact("a8_timeline_bins", oracle(["scored_flows"], "n AS (SELECT pred, row_number() OVER (ORDER BY flow_id) - 1 AS i, greatest(1, count(*) OVER () // 12) AS sz FROM scored_flows), b AS (SELECT CAST(least(i // sz + 1, 12) AS INT) AS bin, count(*) AS t, CAST(sum(pred) AS BIGINT) AS a FROM n GROUP BY 1) SELECT bin, t - a AS normal, a AS attacks, round(CAST(a AS DOUBLE) / t * 100, 2) AS detection_rate FROM b"))
def _(s, d):
    return A.timeline_bins(view(s, d, "scored_flows"), ["flow_id"], "pred")


@exact("a9_traffic_summary", oracle(["conn_log"], TRIAGE + " SELECT count(*) AS records, min(timestamp) AS first_ts, max(timestamp) AS last_ts, (SELECT count(*) FROM lab) AS total_anomalies FROM conn_log"))
def _(s, d):
    return W.traffic_summary(conn(s, d), triage_rows(s, d))


@exact("a10_confusion", oracle(["scored_flows"], CONFUSION + " SELECT * FROM cm"))
def _(s, d):
    return E.confusion(view(s, d, "scored_flows"))


@exact("a11_classification_report", oracle(["scored_flows"], CONFUSION + """, m AS (SELECT tn / CAST(tn + fn AS DOUBLE) AS p0, tn / CAST(tn + fp AS DOUBLE) AS r0, tn + fp AS s0, tp / CAST(tp + fp AS DOUBLE) AS p1, tp / CAST(tp + fn AS DOUBLE) AS r1, fn + tp AS s1,
  (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE) AS acc, tn + fp + fn + tp AS t FROM cm), f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM m)
 SELECT 'Normal' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f UNION ALL SELECT 'Attack', p1, r1, f1, s1 FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, t FROM f
 UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, t FROM f UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / t, (r0 * s0 + r1 * s1) / t, (f0 * s0 + f1 * s1) / t, t FROM f"""))
def _(s, d):
    return E.classification_report(view(s, d, "scored_flows"))


@exact("a12_binary_metrics", oracle(["scored_flows"], METRICS_SQL + " SELECT * FROM mf"))
def _(s, d):
    return E.binary_metrics(view(s, d, "scored_flows"))


@exact("a13_roc_curve", oracle(["scored_flows"], CURVE + f" SELECT threshold, fpr, rec AS tpr FROM pt UNION ALL SELECT {INF}, 0, 0"))
def _(s, d):
    return E.roc_curve(scored(s, d))


@exact("a13_roc_auc", oracle(["scored_flows"], CURVE + " SELECT sum((fp - fp0) * (tp + tp0) / 2) / max(np) / max(nn) AS roc_auc FROM pt"))
def _(s, d):
    return E.roc_auc(scored(s, d))


@exact("a14_pr_curve", oracle(["scored_flows"], CURVE + " SELECT threshold, prec AS precision, rec AS recall FROM pt UNION ALL SELECT NULL, 1, 0"))
def _(s, d):
    return E.pr_curve(scored(s, d))


@exact("a15_average_precision", oracle(["scored_flows"], CURVE + " SELECT sum(pos / np * prec) AS average_precision FROM pt"))
def _(s, d):
    return E.average_precision(scored(s, d))


@exact("a16_pr_auc_trapezoid", oracle(["scored_flows"], CURVE + " SELECT sum(pos / np * (prec + prev) / 2) AS pr_auc FROM pt"))
def _(s, d):
    return E.pr_auc_trapezoid(scored(s, d))


@exact("a17_best_f1_threshold", oracle(["scored_flows"], CURVE + " SELECT threshold, prec AS precision, rec AS recall, 2 * prec * rec / greatest(prec + rec, 1e-9) AS f1 FROM pt ORDER BY f1 DESC, threshold LIMIT 1"))
def _(s, d):
    return E.best_f1_threshold(scored(s, d))


@exact("a18_threshold_sweep", oracle(["scored_flows"], """gr AS (SELECT CAST(0.05 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS c FROM range(0, 15) x(i)),
 o AS (SELECT if_score, row_number() OVER (ORDER BY if_score) - 1 AS r, count(*) OVER () AS n FROM scored_flows), th AS (SELECT c, if_score AS t FROM gr JOIN o ON o.r = CAST(floor(n * c) AS BIGINT)),
 cn AS (SELECT c, t, CAST(sum(CASE WHEN if_score <= t AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN if_score <= t AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN if_score > t AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM scored_flows, th GROUP BY c, t),
 pr AS (SELECT c, t, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM cn) SELECT c AS contamination, t AS threshold, p AS precision, r AS recall, 2 * p * r / (p + r + 1e-9) AS f1 FROM pr"""))
def _(s, d):
    return E.threshold_sweep(view(s, d, "scored_flows"))


@exact("a19_operating_point", oracle(["scored_flows"], CONFUSION + " SELECT fp / CAST(fp + tn AS DOUBLE) AS fpr, tp / CAST(tp + fn AS DOUBLE) AS tpr, tp / CAST(tp + fp AS DOUBLE) AS precision, (tp + fn) / CAST(tn + fp + fn + tp AS DOUBLE) AS no_skill FROM cm"))
def _(s, d):
    return E.operating_point(view(s, d, "scored_flows"))


@exact("a20_cohens_d", oracle(["raw_flows"], f"{CORE}, {FIN}, " + "d AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (avg(CASE WHEN y = 1 THEN {c} END) - avg(CASE WHEN y = 0 THEN {c} END)) / (sqrt((var_pop(CASE WHEN y = 1 THEN {c} END) + var_pop(CASE WHEN y = 0 THEN {c} END)) / 2) + 1e-9) AS cohens_d FROM fin" for c in CORE_NAMES) + ") SELECT * FROM d"))
def _(s, d):
    return E.cohens_d(fin(s, d), CORE_NAMES)


@exact("a21_score_stats", oracle(["scored_flows"], "SELECT y AS class, avg(if_score) AS mean, median(if_score) AS median, stddev_samp(if_score) AS std, (SELECT max(if_score) FROM scored_flows WHERE pred = 1) AS boundary FROM scored_flows GROUP BY y"))
def _(s, d):
    return E.score_stats(view(s, d, "scored_flows"))


HIST = """h AS (SELECT class, least(CAST(floor((v - lo) / (hi - lo) * CAST({bins} AS DOUBLE)) AS INT), {bins} - 1) AS bin, lo, (hi - lo) / {bins} AS w FROM src, rg WHERE v >= lo AND v <= hi),
 c AS (SELECT class, bin, lo, w, count(*) AS n FROM h GROUP BY 1, 2, 3, 4), t AS (SELECT class, count(*) AS total FROM h GROUP BY class)
 SELECT c.class, bin, lo + bin * w AS left_edge, n, n / (total * w) AS density FROM c JOIN t ON t.class = c.class"""


@exact("a22_histogram", oracle(["scored_flows"], "src AS (SELECT y AS class, if_score AS v FROM scored_flows), rg AS (SELECT min(v) AS lo, max(v) AS hi FROM src), " + HIST.format(bins=59)))
def _(s, d):
    return E.histogram(view(s, d, "scored_flows"), "if_score")


@exact("a22_winsorised_histogram", oracle(["raw_flows"], f"{CORE}, {FIN}, q AS (SELECT y, quantile_cont(pkt_len_mean, CAST(0.995 AS DOUBLE)) AS cap FROM fin GROUP BY y), src AS (SELECT fin.y AS class, least(pkt_len_mean, cap) AS v FROM fin JOIN q ON q.y = fin.y), rg AS (SELECT CAST(0 AS DOUBLE) AS lo, quantile_cont(v, CAST(0.99 AS DOUBLE)) AS hi FROM src), " + HIST.format(bins=49)))
def _(s, d):
    return E.winsorised_histogram(fin(s, d).select("y", "pkt_len_mean"), "pkt_len_mean")


@exact("a23_kde", oracle(["scored_flows"], """st AS (SELECT y, min(if_score) - CAST(0.01 AS DOUBLE) AS lo, max(if_score) + CAST(0.01 AS DOUBLE) AS hi, CAST(0.12 AS DOUBLE) * stddev_samp(if_score) AS h, count(*) AS n FROM scored_flows GROUP BY y),
 g AS (SELECT y, if_score AS s, count(*) AS w FROM scored_flows GROUP BY 1, 2), gr AS (SELECT y, i, lo + i * ((hi - lo) / 499) AS x, h, n FROM st, range(0, 500) r(i))
 SELECT gr.y AS class, CAST(i AS INT) AS point, x, sum(w * exp(-0.5 * ((x - s) / h) * ((x - s) / h))) / (max(n) * max(h) * sqrt(2 * pi())) AS density FROM gr JOIN g ON g.y = gr.y GROUP BY gr.y, i, x"""))
def _(s, d):
    return E.kde(view(s, d, "scored_flows"))


@exact("a24_box_stats", oracle(["raw_flows"], f"{CORE}, {FIN}, " + "lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, y AS class, ln(1 + {c}) AS v FROM fin" for c in ("flow_byts_s", "flow_pkts_s", "syn_flag"))
    + """), q AS (SELECT feature, class, quantile_cont(v, CAST(0.25 AS DOUBLE)) AS q1, median(v) AS median, quantile_cont(v, CAST(0.75 AS DOUBLE)) AS q3 FROM lg GROUP BY 1, 2)
 SELECT lg.feature, lg.class, q1, median, q3, least(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), q1) AS whisker_lo, greatest(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), q3) AS whisker_hi,
  count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers FROM lg JOIN q ON q.feature = lg.feature AND q.class = lg.class GROUP BY 1, 2, 3, 4, 5"""))
def _(s, d):
    return E.box_stats(fin(s, d), ["flow_byts_s", "flow_pkts_s", "syn_flag"])


@exact("a25_percentile_threshold", oracle(["scored_flows"], "SELECT quantile_cont(if_score, CAST(0.4 AS DOUBLE)) AS threshold FROM scored_flows"))
def _(s, d):
    df = view(s, d, "scored_flows")
    return df.sparkSession.createDataFrame([(E.percentile_threshold(df, "if_score", 0.4),)], "threshold double")


@exact("a26_contamination", oracle(["scored_flows"], "SELECT CASE WHEN avg(y) > 0 AND avg(y) < 1 THEN avg(y) ELSE 0.45 END AS contamination FROM scored_flows"))
def _(s, d):
    return s.createDataFrame([(E.contamination(view(s, d, "scored_flows")),)], "contamination double")


@exact("a27_global_attribution", oracle(["attributions"], "SELECT feature, avg(abs(impact)) AS mean_abs_impact FROM attributions GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 10"))
def _(s, d):
    return E.global_attribution(view(s, d, "attributions"))


@exact("a28_cv_summary", oracle(["scored_flows"], "f AS (SELECT y + 2 * (length(flow_id) % 3) AS fold, avg(prob) AS f1 FROM scored_flows GROUP BY 1) SELECT avg(f1) AS mean, stddev_pop(f1) AS std FROM f"))
def _(s, d):
    folds = view(s, d, "scored_flows").groupBy((F.col("y") + 2 * (F.length("flow_id") % 3)).alias("fold")).agg(F.avg("prob").alias("f1"))
    return E.cv_summary(folds)


@exact("a31_min_score_per_window", oracle(["conn_log"], WINFEAT + f' SELECT "window", min({WSCORE}) AS min_score FROM wf GROUP BY 1'))
def _(s, d):
    return W.min_score_per_window(window_scores(s, d))


@exact("a32_score_label_correlation", oracle(["scored_flows"], "SELECT abs(corr(if_score, y)) AS abs_corr FROM scored_flows"))
def _(s, d):
    return E.score_label_correlation(view(s, d, "scored_flows"))


# ---- order-dependent -----------------------------------------------------------------------------------
def episodes_sql(source: str, key: str, gap: str = "INTERVAL 15 MINUTE") -> str:
    """Row-by-row fold of ``source`` (type, timestamp, src_ip, if_score, ``key``), yielding the kept keys as ``kept``."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY timestamp, src_ip, {key}) AS rn FROM {source}),
 fo AS (SELECT type, rn, {key} AS rep, timestamp AS rts, if_score AS rs, CAST(NULL AS VARCHAR) AS done FROM (SELECT type, rn, timestamp, if_score, CAST({key} AS VARCHAR) AS {key} FROM o WHERE rn = 1) a
  UNION ALL SELECT o.type, o.rn, CASE WHEN o.timestamp - rts > {gap} OR o.if_score < rs THEN CAST(o.{key} AS VARCHAR) ELSE rep END, CASE WHEN o.timestamp - rts > {gap} OR o.if_score < rs THEN o.timestamp ELSE rts END,
   CASE WHEN o.timestamp - rts > {gap} OR o.if_score < rs THEN o.if_score ELSE rs END, CASE WHEN o.timestamp - rts > {gap} THEN rep END FROM fo JOIN o ON o.type = fo.type AND o.rn = fo.rn + 1),
 kept AS (SELECT type, done AS k FROM fo WHERE done IS NOT NULL UNION ALL SELECT type, arg_max(rep, rn) FROM fo GROUP BY type)"""


@exact("w1_episodes", oracle(["anomaly_rows"], episodes_sql("anomaly_rows", "event_id") + " SELECT a.* FROM anomaly_rows a JOIN kept ON kept.type = a.type AND kept.k = CAST(a.event_id AS VARCHAR)", recursive=True))
def _(s, d):
    return A.episodes(view(s, d, "anomaly_rows"), tie=("src_ip", "event_id"))


@exact("w2_bucket_best", oracle(["anomaly_rows"], f"r AS (SELECT *, {BUCKET.format('30 minutes', 'timestamp')} AS bucket FROM anomaly_rows) SELECT event_id, timestamp, src_ip, type, severity, if_score, bucket FROM r QUALIFY row_number() OVER (PARTITION BY type, bucket ORDER BY if_score, timestamp, event_id) = 1"))
def _(s, d):
    return A.bucket_best(view(s, d, "anomaly_rows"), tie=("event_id",))


@exact("w3_severity_rank", oracle(["anomaly_rows"], "SELECT event_id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END, timestamp, event_id) AS rank FROM anomaly_rows"))
def _(s, d):
    return A.severity_rank(view(s, d, "anomaly_rows"), ("timestamp", "event_id")).select("event_id", "severity", "rank")


@exact("w4_rank_attribution", oracle(["attributions"], "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, idx) - 1 AS INT) AS pos, feature, impact FROM attributions"))
def _(s, d):
    r = listed(s, d).select("id", F.posexplode(S.rank_attribution("contributions")).alias("pos", "c"))
    return r.select("id", "pos", F.col("c.feature").alias("feature"), F.col("c.impact").alias("impact"))


@exact("w5_last_n_snapshots", oracle(["history"], f"SELECT {BUCKET.format('1 hour', 'timestamp')} AS \"window\", count(*) AS n FROM history GROUP BY 1 ORDER BY 1 DESC LIMIT 30"))
def _(s, d):
    h = view(s, d, "history").groupBy(F.window("timestamp", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return H.last_n_snapshots(h.select(F.col("w.start").alias("window"), "n"), 30)


SETTING_WRITES = "CASE id % 3 WHEN 0 THEN 'context_window' WHEN 1 THEN 'confidence_threshold' ELSE 'dark_mode' END"


@exact("w6_latest_per_key", oracle(["history"], f"w AS (SELECT id, {SETTING_WRITES} AS key, CAST(dst_port AS STRING) AS value FROM history), m AS (SELECT key, arg_max(value, id) AS value FROM w GROUP BY key) "
    "SELECT coalesce(m.key, d.key) AS key, coalesce(m.value, d.value) AS value FROM m FULL JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in H.DEFAULT_SETTINGS.items()) + ") AS d(key, value) ON d.key = m.key"))
def _(s, d):
    w = view(s, d, "history").select("id", F.expr(SETTING_WRITES).alias("key"), F.col("dst_port").cast("string").alias("value"))
    return H.latest_per_key(w, defaults=H.DEFAULT_SETTINGS)


# ---- sort, limit, top-k, sets, samples -----------------------------------------------------------------
@exact("l1_top_talkers", oracle(["packets"], FIVE + ", t AS ((SELECT 'src' AS side, src_ip AS ip, count(*) AS n FROM fl GROUP BY 2 ORDER BY n DESC, ip LIMIT 5) UNION ALL (SELECT 'dst', dst_ip AS ip, count(*) AS n FROM fl GROUP BY 2 ORDER BY n DESC, ip LIMIT 5)) SELECT * FROM t"))
def _(s, d):
    f = FL.assemble_flows(view(s, d, "packets"))
    side = lambda ip, name: A.top_talkers(f, ip).select(F.lit(name).alias("side"), "ip", "n")
    return side("src_ip", "src").unionByName(side("dst_ip", "dst"))


@exact("l2_top_alerts", oracle(["scored_flows"], "SELECT * FROM scored_flows ORDER BY prob DESC, flow_id LIMIT 25"))
def _(s, d):
    return A.top_alerts(view(s, d, "scored_flows"), 25, "prob", "flow_id")


@exact("l3_first_of_each", oracle(["scored_flows"], "t AS ((SELECT * FROM scored_flows WHERE pred = 1 ORDER BY flow_id LIMIT 50) UNION ALL (SELECT * FROM scored_flows WHERE pred = 0 ORDER BY flow_id LIMIT 50)) SELECT * FROM t"))
def _(s, d):
    return A.first_of_each(view(s, d, "scored_flows"), "pred", "flow_id", 50)


PAGE = "FROM history WHERE (src_ip ILIKE '%port%' OR dst_ip ILIKE '%port%' OR attack_type ILIKE '%port%') AND mode = 'Online' AND prediction = 1"


@exact("l4_history_page", oracle(["history"], f"SELECT * {PAGE} ORDER BY confidence ASC, id OFFSET 30 LIMIT 15"))
def _(s, d):
    return H.history_page(view(s, d, "history"), "port", "Online", 1, None, 15, 30, "confidence", "asc")[0]


@exact("l4_history_deep_page", oracle(["history"], "SELECT * FROM history ORDER BY confidence DESC, id OFFSET 1700 LIMIT 40"))
def _(s, d):
    """A page far behind, found by counted key ranges."""
    return H.history_page(view(s, d, "history"), None, None, None, None, 40, 1700, "confidence", "desc", plain_rows=200)[0]


@exact("l4_history_page_after", oracle(["history"], "SELECT * FROM history WHERE mode = 'Online' ORDER BY src_ip DESC, id OFFSET 50 LIMIT 25"))
def _(s, d):
    """The third page, by the last record of the second."""
    h, seen = view(s, d, "history"), None
    for _ in range(2):
        page = H.history_page(h, mode="Online", sort_by="src_ip", after=seen)[0].collect()
        seen = (page[-1]["src_ip"], page[-1]["id"])
    return H.history_page(h, mode="Online", sort_by="src_ip", after=seen)[0]


@exact("l4_history_total", oracle(["history"], f"SELECT count(*) AS total {PAGE}"))
def _(s, d):
    return H.history_page(view(s, d, "history"), "port", "Online", 1)[1]


@exact("l4_history_page_default_sort", oracle(["history"], "SELECT * FROM history WHERE protocol = 'UDP' ORDER BY timestamp DESC, id LIMIT 25"))
def _(s, d):
    return H.history_page(view(s, d, "history"), protocol="UDP", sort_by="shap_explanation", sort_order="sideways")[0]


@exact("l5_latest", oracle(["history"], "SELECT * FROM history ORDER BY id DESC LIMIT 50"))
def _(s, d):
    return H.latest(view(s, d, "history"), 50)


@exact("l6_record_attribution", oracle(["attributions", "history"], TOP4.replace("ORDER BY abs(impact) DESC", "ORDER BY impact DESC") + f" SELECT h.id, h.attack_type, coalesce('{S.RECORD_REASON[0]}' || h.attack_type || '{S.RECORD_REASON[1]}' || t || '{S.RECORD_REASON[2]}', '{S.SUBTLE_TEXT}') AS text_explanation FROM history h JOIN se ON se.id = h.id WHERE h.id = 321"))
def _(s, d):
    h = view(s, d, "history").join(listed(s, d).select("id", F.to_json("contributions").alias("shap_explanation")), "id")
    return H.record_attribution(h, 321).select("id", "attack_type", "text_explanation")


@exact("u1_label_union", oracle(["raw_flows"], "SELECT flow_id, label AS true_label FROM raw_flows"))
def _(s, d):
    r = view(s, d, "raw_flows").select("flow_id", "label")
    return U.label_union(r.where("label = 1").drop("label"), r.where("label = 0").drop("label"))


HASH = "md5(flow_id || '|42')"


@exact("u2_sample_n", oracle(["raw_flows"], f"t AS ((SELECT flow_id, label FROM raw_flows WHERE label = 1 ORDER BY {HASH}, flow_id LIMIT 6000) UNION ALL (SELECT flow_id, label FROM raw_flows WHERE label = 0 ORDER BY {HASH}, flow_id LIMIT 6000)) SELECT * FROM t"))
def _(s, d):
    return U.sample_per_class(view(s, d, "raw_flows").select("flow_id", "label"), 6000, 42, "flow_id")


@exact("u3_shuffle", oracle(["raw_flows"], f"SELECT flow_id, row_number() OVER (ORDER BY {HASH}, flow_id) - 1 AS pos FROM raw_flows"))
def _(s, d):
    return U.shuffle_position(view(s, d, "raw_flows").select("flow_id"), 42, "flow_id")


@exact("u4_stratified_split", oracle(["raw_flows"], f"r AS (SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY {HASH}, flow_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM raw_flows) SELECT flow_id, label, CASE WHEN i < round(n * CAST(0.6 AS DOUBLE)) THEN 0 WHEN i < round(n * CAST(0.8 AS DOUBLE)) THEN 1 ELSE 2 END AS split FROM r"))
def _(s, d):
    return U.stratified_split(view(s, d, "raw_flows").select("flow_id", "label"), [0.6, 0.2, 0.2], "label", "flow_id")


@exact("u5_stratified_folds", oracle(["raw_flows"], f"SELECT flow_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {HASH}, flow_id) - 1) % 5 AS INT) AS fold FROM raw_flows"))
def _(s, d):
    return U.stratified_folds(view(s, d, "raw_flows").select("flow_id", "label"), 5, "label", "flow_id")


@exact("u6_head_then_sample", oracle(["raw_flows"], f"h AS (SELECT flow_id, label FROM raw_flows ORDER BY flow_id LIMIT 10000) SELECT * FROM h ORDER BY {HASH}, flow_id LIMIT 5000"))
def _(s, d):
    return U.head_then_sample(view(s, d, "raw_flows").select("flow_id", "label"), 5000, 42, "flow_id")


# ---- detection and streams (batch form) ----------------------------------------------------------------
@exact("m3_flag", oracle(["scored_flows"], "t AS (SELECT quantile_cont(if_score, CAST(0.02 AS DOUBLE)) AS t FROM scored_flows) SELECT flow_id, if_score, CASE WHEN if_score < t THEN -1 ELSE 1 END AS if_label FROM scored_flows, t"))
def _(s, d):
    return E.flag_by_contamination(view(s, d, "scored_flows").select("flow_id", "if_score"), 0.02)


@exact("t1_context_window", oracle(["packets"], f"SELECT {BUCKET.format('30 seconds', 'make_timestamp(CAST(round(time * 1000000) AS BIGINT))')} AS \"window\", count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes FROM packets GROUP BY 1"))
def _(s, d):
    return P.window_counts(view(s, d, "packets")).withColumn("window", F.col("window.start").cast("timestamp_ntz"))


@exact("t1_context_window_sliding", oracle(["packets"], f"b AS (SELECT {BUCKET.format('10 seconds', 'make_timestamp(CAST(round(time * 1000000) AS BIGINT))')} AS b, length FROM packets), x AS (SELECT b - k * INTERVAL 10 SECOND AS \"window\", length FROM b, range(0, 3) r(k)) SELECT \"window\", count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes FROM x GROUP BY 1"))
def _(s, d):
    return P.window_counts(view(s, d, "packets"), 30, 10).withColumn("window", F.col("window.start").cast("timestamp_ntz"))


@exact("t3_stream_flows", oracle(["packets"], FIVE_W + " SELECT * FROM fl"))
def _(s, d):
    return P.stream_flows(view(s, d, "packets")).withColumn("window", F.col("window.start").cast("timestamp_ntz"))


def window_scored(s, d):
    pk = view(s, d, "packets")  # quiet spells of two minutes after every 2000 packets
    f = surrogate(P.stream_flows(pk.withColumn("time", F.col("time") + F.floor(F.col("packet_id") / 2000) * 120)))
    return f.withColumns(S.threat_type(F.col("is_anomaly") == 1))


T5 = FIVE_W + f", sc AS (SELECT *, {SURROGATE_SQL} FROM fl)"


@exact("t5_snapshot", oracle(["packets"], T5.replace("FROM packets)", "FROM (SELECT * REPLACE (time + floor(packet_id / 2000) * 120 AS time) FROM packets) x)") + """, ag5 AS (SELECT "window", CAST(sum(total_pkts) AS BIGINT) AS total_packets, count(*) AS total_flows, CAST(count(*) - sum(is_anomaly) AS BIGINT) AS normal_flows, CAST(sum(is_anomaly) AS BIGINT) AS attack_flows,
 CAST(sum(is_anomaly) AS DOUBLE) / count(*) * 100 AS detection_rate, avg(prob) * 100 AS avg_confidence, avg(if_score) AS avg_if_score, avg(prob) AS avg_xgb_prob,
 count(CASE WHEN protocol = 'TCP' THEN 1 END) AS n_tcp, count(CASE WHEN protocol = 'UDP' THEN 1 END) AS n_udp, count(CASE WHEN protocol = 'Other' THEN 1 END) AS n_other FROM sc GROUP BY 1),
 src AS (SELECT "window", string_agg(src_ip || '=' || CAST(n AS STRING), ',' ORDER BY src_ip) AS top_src FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY n DESC, src_ip) AS r FROM (SELECT "window", src_ip, count(*) AS n FROM sc GROUP BY 1, 2) c) k WHERE r <= 5 GROUP BY 1),
 g5 AS (SELECT unnest(generate_series((SELECT min("window") FROM ag5), (SELECT max("window") FROM ag5), INTERVAL 30 SECOND)) AS "window")
 SELECT g5."window", """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total_packets", "total_flows", "normal_flows", "attack_flows", "detection_rate", "avg_confidence", "avg_if_score", "avg_xgb_prob", "n_tcp", "n_udp", "n_other"))
    + """, CAST(0 AS BIGINT) AS suspicious_flows, coalesce(top_src, '') AS top_src FROM g5 LEFT JOIN ag5 ON ag5."window" = g5."window" LEFT JOIN src ON src."window" = g5."window" """))
def _(s, d):
    sc = window_scored(s, d)
    snap = P.snapshot(sc, P.window_grid(sc))
    num = lambda k: F.coalesce(F.try_element_at("protocols", F.lit(k)), F.lit(0))
    pairs = F.transform(F.map_entries("top_src_ips"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return snap.select(
        F.col("window.start").cast("timestamp_ntz").alias("window"),
        "total_packets", "total_flows", "normal_flows", "suspicious_flows", "attack_flows",
        "detection_rate", "avg_confidence", "avg_if_score", "avg_xgb_prob",
        num("TCP").alias("n_tcp"), num("UDP").alias("n_udp"), num("Other").alias("n_other"),
        F.array_join(pairs, ",").alias("top_src"),
    )


@exact("t6_dashboard_timeline", oracle(["packets"], T5 + """, ag6 AS (SELECT "window", CAST(sum(total_pkts) AS BIGINT) AS packets, count(*) AS flows, CAST(count(*) - sum(is_anomaly) AS BIGINT) AS normal, CAST(sum(is_anomaly) AS BIGINT) AS attacks, CAST(sum(is_anomaly) AS DOUBLE) / count(*) * 100 AS detection_rate FROM sc GROUP BY 1)
 SELECT strftime("window" + INTERVAL 30 SECOND, '%H:%M:%S') AS time, packets, flows, normal, attacks, detection_rate FROM ag6 ORDER BY "window" DESC LIMIT 30"""))
def _(s, d):
    f = surrogate(P.stream_flows(view(s, d, "packets"))).withColumns(S.threat_type(F.col("is_anomaly") == 1))
    return P.dashboard_timeline(P.snapshot(f)).drop("window")


@exact("t6_dashboard_counts", oracle(["packets"], T5 + f""", aw AS (SELECT "window" FROM sc GROUP BY 1 ORDER BY 1 DESC LIMIT 30), lb AS (SELECT "window", {THREAT_SQL} AS name FROM sc WHERE is_anomaly = 1) SELECT lb."window", name, count(*) AS value FROM lb JOIN aw ON aw."window" = lb."window" GROUP BY 1, 2"""))
def _(s, d):
    f = surrogate(P.stream_flows(view(s, d, "packets"))).withColumns(S.threat_type(F.col("is_anomaly") == 1))
    return P.dashboard_counts(P.snapshot(f), "attacks").withColumn("window", F.col("window.start").cast("timestamp_ntz"))


@exact("t7_three_tuple_alerts", oracle(["packets"], THREE_W + f""", sc AS (SELECT *, {SURROGATE_SQL} FROM fl), pr AS (SELECT "window", src_ip, dst_ip, dst_port, is_anomaly, CASE WHEN is_anomaly = 1 THEN prob ELSE 1 - prob END AS probability FROM sc)
 SELECT "window", src_ip, dst_ip, dst_port, is_anomaly, probability FROM pr QUALIFY row_number() OVER (PARTITION BY "window", is_anomaly ORDER BY probability DESC, src_ip, dst_ip, dst_port) <= 25"""))
def _(s, d):
    f = surrogate(P.stream_flows_3tuple(view(s, d, "packets")))
    return P.ranked_alerts(f).select(F.col("window.start").cast("timestamp_ntz").alias("window"), "src_ip", "dst_ip", "dst_port", "is_anomaly", "probability")


# ---- composites ----------------------------------------------------------------------------------------
@exact("q1_triage", oracle(["conn_log"], TRIAGE + ", tr AS (SELECT *, CAST(timestamp AS VARCHAR) || src_ip AS k FROM lab), " + episodes_sql("tr", "k") + """
 SELECT row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END, timestamp, src_ip) AS rank, timestamp, src_ip, tr.type, severity, if_score, n_bytes, n_packets, n_dst_ports, failed_ratio, hour
 FROM tr JOIN kept ON kept.type = tr.type AND kept.k = tr.k""", recursive=True))
def _(s, d):
    from flowarden.plans.triage import triage

    return triage(window_scores(s, d), contamination=0.1)


@exact("q11_threat_report_data", oracle(["conn_log"], TRIAGE + ", tr AS (SELECT *, CAST(timestamp AS VARCHAR) || src_ip AS k FROM lab), " + episodes_sql("tr", "k") + ", " + CONTEXT_SQL + """
 SELECT tr.type, c.attack_type AS context_type, c.mitre, c.n_cves, count(*) AS n, min(severity) AS severity FROM tr JOIN kept ON kept.type = tr.type AND kept.k = tr.k
 JOIN ctx c ON c.attack_type = tr.type GROUP BY 1, 2, 3, 4""", recursive=True))
def _(s, d):
    from flowarden.plans.triage import threat_report_data, triage

    full, _ = threat_report_data(triage(window_scores(s, d), contamination=0.1))
    return full.groupBy("type", "context_type", "mitre", F.size("cves").alias("n_cves")).agg(F.count(F.lit(1)).alias("n"), F.min("severity").alias("severity"))
