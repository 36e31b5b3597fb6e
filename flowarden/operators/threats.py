"""Threat-context dimension and its lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT_SCHEMA = (
    "attack_type string, description string, mitre string, "
    "cves array<struct<id:string,summary:string,cvss:double>>, mitigations array<string>"
)

# The seven-row threat context that enrichment results must equal.
THREAT_CONTEXT = [
    (
        "Port Scan",
        "Port scanning probes a host or network to discover open services. It is typically the reconnaissance phase of a multi-stage attack.",
        "T1046 — Network Service Discovery",
        [
            ("CVE-2021-44228", "Log4Shell — exploited after port 8080/8443 enumeration reveals Log4j-backed services.", 10.0),
            ("CVE-2022-0847", "Dirty Pipe — local privilege escalation after SSH (port 22) is reached via scan.", 7.8),
        ],
        [
            "Block unsolicited inbound SYN packets at the perimeter firewall.",
            "Enable port-scan detection on IDS (Snort rule sid:1000001).",
            "Restrict internal host-to-host port enumeration with micro-segmentation.",
        ],
    ),
    (
        "Brute Force",
        "Repeated failed authentication attempts against a single port, typically SSH (22), RDP (3389), or HTTP (80/443).",
        "T1110 — Brute Force",
        [
            ("CVE-2023-38408", "OpenSSH remote code execution — brute-forced credential access enables exploit delivery.", 9.8),
            ("CVE-2019-0708", "BlueKeep RDP — attackers brute-force weak RDP credentials then pivot with BlueKeep.", 9.8),
        ],
        [
            "Enforce account lockout after 5 failed attempts.",
            "Deploy fail2ban or equivalent on all internet-facing services.",
            "Require MFA for SSH and RDP; disable password authentication where possible.",
            "Rate-limit inbound connections per source IP at the firewall.",
        ],
    ),
    (
        "Traffic Spike",
        "A sudden, sustained surge in inbound traffic volume — characteristic of volumetric DDoS or data flood attacks.",
        "T1498 — Network Denial of Service",
        [
            ("CVE-2022-26143", "TP-240 amplification DDoS — reflector exploited to produce >4 billion:1 amplification ratio.", 8.6),
            ("CVE-2021-3156", "Sudo heap overflow — exploited post-DDoS once legitimate traffic is disrupted.", 7.8),
        ],
        [
            "Enable rate-limiting and traffic shaping at the upstream edge.",
            "Activate scrubbing centre / CDN DDoS protection (e.g., Cloudflare Magic Transit).",
            "Alert on traffic volume exceeding 3× 15-minute baseline.",
            "Validate source IPs with BCP-38 anti-spoofing filters.",
        ],
    ),
    (
        "Data Exfiltration",
        "Sustained high-volume outbound transfers from a single internal host — consistent with an attacker staging and transferring sensitive data.",
        "T1048 — Exfiltration Over Alternative Protocol",
        [
            ("CVE-2023-0669", "GoAnywhere MFT RCE — used in Cl0p ransomware campaign that exfiltrated 130+ organisations.", 7.2),
            ("CVE-2021-26855", "ProxyLogon (Exchange) — gave attackers mailbox access enabling large-scale email exfiltration.", 9.8),
        ],
        [
            "Enforce egress filtering — alert on outbound transfers >500 MB from a single host.",
            "Enable DLP rules on the network boundary.",
            "Inspect and log DNS queries for long or encoded subdomains (DNS tunnelling).",
            "Segment high-value data stores and require explicit egress approval.",
        ],
    ),
    (
        "Night Activity",
        "Significant connection volume occurring during off-hours (00:00–05:59). Often indicates automated/scripted attacker activity or compromised host beaconing.",
        "T1029 — Scheduled Transfer",
        [
            ("CVE-2020-1472", "Zerologon — exploited in off-hours DC attacks by ransomware operators to reset machine passwords.", 10.0),
            ("CVE-2021-34527", "PrintNightmare — privilege escalation used in overnight lateral movement campaigns.", 8.8),
        ],
        [
            "Alert on any outbound connection from servers during 00:00–05:59 outside of maintenance windows.",
            "Implement time-of-day access controls for privileged accounts.",
            "Require change-management approval for overnight batch jobs.",
        ],
    ),
    (
        "Botnet C&C",
        "Long idle flows with low packet rate and irregular timing — hallmarks of botnet command-and-control beacon traffic.",
        "T1071 — Application Layer Protocol C2",
        [
            ("CVE-2021-44228", "Log4Shell — widely used in Mirai/Muhstik botnet initial access campaigns.", 10.0),
            ("CVE-2017-0144", "EternalBlue (SMB) — Mirai and subsequent botnets exploited this for rapid propagation.", 9.3),
        ],
        [
            "Block known C&C IP ranges using threat intelligence feeds (e.g., Abuse.ch).",
            "Inspect long-duration low-bandwidth flows — typical C&C beacon signature.",
            "Enable DNS RPZ (Response Policy Zone) to sinkhole known botnet domains.",
            "Hunt for processes making outbound connections on unusual ports.",
        ],
    ),
    (
        "Unknown",
        "The Isolation Forest flagged this window as anomalous but no specific attack pattern matched the rule-based classifier. Manual review recommended.",
        "T1040 — Network Sniffing (investigate further)",
        [],
        [
            "Capture a full PCAP of the flagged window for manual inspection.",
            "Cross-reference source IP against threat intelligence (VirusTotal, Shodan).",
            "Review host logs for the flagged source IP at the anomaly timestamp.",
        ],
    ),
]


def threat_context(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THREAT_CONTEXT, CONTEXT_SCHEMA)


def enrich_threats(anomalies: DataFrame, context: DataFrame | None = None, type_col: str = "type") -> DataFrame:
    """Add the context of each row's type; types without one get the ``Unknown`` row.

    The built-in dimension has seven rows and is broadcast; the join to a supplied one is left to the planner.
    """
    if context is None:
        dim = F.broadcast(threat_context(anomalies.sparkSession))
    else:
        dim = context
    types = dim.select(F.col("attack_type").alias(type_col), F.col("attack_type").alias("__known"))
    keyed = anomalies.join(types, type_col, "left").withColumn("context_type", F.coalesce("__known", F.lit("Unknown")))
    full = keyed.join(dim.withColumnRenamed("attack_type", "context_type"), "context_type", "left")
    return full.select(*anomalies.columns, "context_type", "description", "mitre", "cves", "mitigations")


def explode_cves(context: DataFrame) -> DataFrame:
    """One row per type and CVE; a type without CVEs keeps one row of NULLs."""
    rows = context.select("attack_type", F.explode_outer("cves").alias("c"))
    return rows.select("attack_type", F.col("c.id").alias("cve_id"), F.col("c.summary").alias("summary"), F.col("c.cvss").alias("cvss"))


def max_cvss(context: DataFrame) -> DataFrame:
    return context.select("attack_type", F.array_max(F.transform("cves", lambda c: c["cvss"])).alias("max_cvss"))
