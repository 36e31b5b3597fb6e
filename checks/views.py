"""Input views over the driver's tables, as SQL that runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOW_ID = """concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                 CAST(l_linenumber AS STRING), CAST(CAST(l_quantity AS INT) AS STRING),
                 CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))"""
PROP = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# name -> (driver tables or earlier views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "conn_log": (["events"], f"""
SELECT event_id, ts AS timestamp, concat('10.0.0.', CAST(user_id % 10 AS STRING)) AS src_ip,
       concat('192.168.1.', CAST({PROP} % 16 AS STRING)) AS dst_ip, {PROP} * 10 AS dst_port,
       CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
       CAST(floor(value * 100) AS BIGINT) AS bytes,
       CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status, '' AS flags
FROM {{events}}"""),
    "packets": (["events"], f"""
SELECT packet_id, CAST(1704067200 AS DOUBLE) + packet_id * CAST(0.05 AS DOUBLE) AS time,
       CASE WHEN packet_id % 2 = 0 THEN a ELSE b END AS src_ip,
       CASE WHEN packet_id % 2 = 0 THEN b ELSE a END AS dst_ip,
       CASE WHEN packet_id % 7 = 0 THEN 0 WHEN packet_id % 2 = 0 THEN pa ELSE pb END AS src_port,
       CASE WHEN packet_id % 7 = 0 THEN 0 WHEN packet_id % 2 = 0 THEN pb ELSE pa END AS dst_port,
       CASE WHEN packet_id % 7 = 0 THEN 'Other' WHEN packet_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
       CAST(40 + floor(value) AS INT) AS length,
       CASE WHEN packet_id % 7 = 0 OR packet_id % 3 = 0 THEN 0 WHEN event_type = 'signup' THEN 2
            WHEN event_type = 'error' THEN 4 WHEN event_type = 'purchase' THEN 17 ELSE 16 END AS tcp_flags
FROM (SELECT event_id AS packet_id, value, event_type, concat('10.0.0.', CAST(user_id % 6 AS STRING)) AS a,
             concat('10.0.0.', CAST({PROP} % 6 AS STRING)) AS b,
             40000 + CAST(user_id % 6 AS INT) AS pa, 80 + {PROP} % 6 AS pb FROM {{events}}) e"""),
    "payloads": (["events"], f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(1704067200 + event_id AS DOUBLE) END AS time,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id % 6 AS STRING)) END AS src_ip,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('10.0.1.', CAST({PROP} % 6 AS STRING)) END AS dst_ip,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 40000 + CAST(user_id % 6 AS INT) END AS src_port,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE 80 + {PROP} % 6 END AS dst_port,
       CASE WHEN event_id % 3 = 0 THEN 'udp' WHEN event_id % 3 = 1 THEN 'tcp' ELSE NULL END AS protocol,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(40 + floor(value) AS INT) END AS length,
       CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS syn_flag,
       CASE WHEN event_type = 'error' THEN 1 ELSE NULL END AS rst_flag,
       CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS fin_flag
FROM {{events}}"""),
    "raw_flows": (["lineitem"], f"""
SELECT {FLOW_ID} AS flow_id, l_quantity * 1000000 AS flow_duration, CAST(l_linenumber * 3 AS DOUBLE) AS tot_fwd_pkts,
       CAST(l_suppkey % 7 AS DOUBLE) AS tot_bwd_pkts, l_extendedprice AS totlen_fwd_pkts,
       l_extendedprice * l_discount AS totlen_bwd_pkts,
       CASE WHEN l_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_partkey % 89 = 0 THEN NULL
            ELSE l_extendedprice / l_quantity END AS flow_byts_per_s,
       CASE WHEN l_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE CAST(l_linenumber * 3 + l_suppkey % 7 AS DOUBLE) / l_quantity END AS flow_pkts_per_s,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey % 8 AS DOUBLE) ELSE CAST(l_orderkey % 3 AS DOUBLE) END AS syn_flag_cnt,
       CASE WHEN l_discount > CAST(0.08 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rst_flag_cnt,
       CASE WHEN l_linestatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS fin_flag_cnt,
       l_extendedprice / CAST(l_linenumber * 3 + l_suppkey % 7 AS DOUBLE) AS pkt_len_mean,
       CAST(0 AS DOUBLE) AS urg_flag_cnt, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
FROM {{lineitem}}"""),
    "scored_flows": (["lineitem"], f"""
SELECT flow_id, y,
       -(CAST(250 + (l_partkey * 31 + l_linenumber * 7) % 300 + 100 * y AS DOUBLE) / CAST(1000 AS DOUBLE)) AS if_score,
       CAST((l_partkey * 17 + l_suppkey) % 600 + 399 * y AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob,
       CASE WHEN (l_partkey * 17 + l_suppkey) % 600 + 399 * y >= 500 THEN 1 ELSE 0 END AS pred
FROM (SELECT {FLOW_ID} AS flow_id, l_partkey, l_suppkey, l_linenumber,
             CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM {{lineitem}}) l"""),
    "anomaly_rows": (["events"], """
SELECT event_id, date_trunc('minute', ts) AS timestamp, concat('10.0.0.', CAST(user_id % 10 AS STRING)) AS src_ip,
       CASE event_type WHEN 'error' THEN 'Brute Force' WHEN 'signup' THEN 'Port Scan' WHEN 'purchase' THEN 'Data Exfiltration'
                       WHEN 'view' THEN 'Night Activity' ELSE 'Something New' END AS type,
       CASE event_type WHEN 'purchase' THEN 'CRITICAL' WHEN 'view' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' ELSE 'HIGH' END AS severity,
       -(CAST((event_id * 7919) % 500 AS DOUBLE) / CAST(1000 AS DOUBLE)) AS if_score
FROM {events}"""),
    "history": (["events"], """
SELECT event_id AS id, ts AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'Online' ELSE 'Offline' END AS mode,
       concat('10.0.0.', CAST(user_id % 10 AS STRING)) AS src_ip,
       concat('192.168.1.', CAST(user_id % 16 AS STRING)) AS dst_ip,
       CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol, CAST(user_id % 1024 AS INT) AS dst_port,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS prediction, value AS confidence,
       CASE WHEN event_type = 'error' THEN 'Port Scan / Recon' ELSE 'Normal' END AS attack_type,
       CAST((event_id * 7919) % 500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS if_score,
       CAST((event_id * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS xgb_prob
FROM {events}"""),
    "attributions": (["events"], """
SELECT e.event_id AS id, f.idx AS idx, f.feature AS feature,
       CAST((e.event_id * 7 + f.idx * 13 * (e.event_id % 5 + 1)) % 200 - 100 AS DOUBLE) / CAST(1000 AS DOUBLE) AS impact
FROM {events} e CROSS JOIN (VALUES (1, 'flow_byts_s'), (2, 'flow_pkts_s'), (3, 'fwd_bytes'), (4, 'bwd_bytes'), (5, 'total_pkts'),
     (6, 'syn_flag'), (7, 'rst_flag'), (8, 'fin_flag'), (9, 'flow_duration_s'), (10, 'pkt_len_mean'), (11, 'if_anomaly_score')) AS f(idx, feature)"""),
    "kdd_lite": (["events"], """
SELECT event_id, value AS duration,
       CASE WHEN event_id % 3 = 0 THEN 'udp' WHEN event_id % 14 = 1 THEN 'icmp' ELSE 'tcp' END AS protocol_type,
       concat('svc', CAST(user_id % 5 AS STRING)) AS service,
       CASE WHEN event_type = 'error' THEN 'REJ' ELSE 'SF' END AS flag,
       CAST(floor(value * 100) AS BIGINT) AS src_bytes, CAST(event_id % 11 AS INT) AS difficulty,
       CASE event_type WHEN 'error' THEN 'neptune' WHEN 'signup' THEN 'portsweep' ELSE ' Normal ' END AS label
FROM {events}"""),
}

# Flow-meter headers of the raw_flows columns.
FLOW_HEADERS = {
    "flow_duration": "Flow Duration", "tot_fwd_pkts": "Tot Fwd Pkts", "tot_bwd_pkts": "Tot Bwd Pkts",
    "totlen_fwd_pkts": "TotLen Fwd Pkts", "totlen_bwd_pkts": "TotLen Bwd Pkts", "flow_byts_per_s": "Flow Byts/s",
    "flow_pkts_per_s": "Flow Pkts/s", "syn_flag_cnt": "SYN Flag Cnt", "rst_flag_cnt": "RST Flag Cnt",
    "fin_flag_cnt": "FIN Flag Cnt", "pkt_len_mean": "Pkt Len Mean", "urg_flag_cnt": "URG Flag Cnt", "label": "Label",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources, sql = VIEWS[name]
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in sources})


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_flows").withColumnsRenamed(FLOW_HEADERS)


def oracle(views: list[str], body: str, recursive: bool = False) -> str:
    """SQL text: the views as leading CTEs, then ``body`` (further CTEs and the final SELECT)."""
    ctes = [f"{v} AS ({VIEWS[v][1].format(**{s: s for s in VIEWS[v][0]})})" for v in views]
    head = ("WITH RECURSIVE " if recursive else "WITH ") if ctes or recursive else ""
    body = body.strip()
    if ctes and not body.upper().startswith("SELECT"):
        return head + ",\n".join(ctes) + ",\n" + body
    return head + ",\n".join(ctes) + "\n" + body
