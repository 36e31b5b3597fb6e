"""Column expressions: coercion, labels, packet flags, verdicts, rule ladders, attribution text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Feature order, display labels and rule thresholds that results depend on.
CORE_FEATURES = [
    "flow_byts_s", "flow_pkts_s", "fwd_bytes", "bwd_bytes", "total_pkts",
    "syn_flag", "rst_flag", "fin_flag", "flow_duration_s", "pkt_len_mean",
]
DISPLAY_NAMES = {
    "flow_byts_s": "Flow Bytes/s",
    "flow_pkts_s": "Flow Packets/s",
    "fwd_bytes": "Fwd Packet Bytes",
    "bwd_bytes": "Bwd Packet Bytes",
    "total_pkts": "Total Packet Count",
    "syn_flag": "SYN Flag Count",
    "rst_flag": "RST Flag Count",
    "fin_flag": "FIN Flag Count",
    "flow_duration_s": "Flow Duration",
    "pkt_len_mean": "Packet Length Mean",
    "if_anomaly_score": "Isolation Forest Anomaly Score",
}
ATTACK_WORDS = ["1", "attack", "anomaly", "malicious"]
LABEL_COLUMNS = ["label", "true_label", "class"]
SEVERITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
DEFAULT_SRC_IP, DEFAULT_DST_IP = "192.168.1.100", "10.0.0.1"
BENIGN_TEXT = "Traffic flow matched the benign baseline signature. No threat detected."
SUBTLE_TEXT = "The anomaly was detected due to a combination of subtle deviations from the baseline traffic profile."
FLOW_REASON = ("The flow was flagged as highly suspicious mainly because ", " contributed the most to the threat signature.")
RECORD_REASON = ("The attack (", ") was detected mainly because ", " contributed the most to the model classification.")

IMPACT_TYPE = "array<struct<feature:string,display_name:string,impact:double>>"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _as_col(c: str | Column) -> Column:
    return col(c) if isinstance(c, str) else c


def to_numeric(c: str | Column, fill: float | None = None) -> Column:
    """Double, or ``fill`` where the value is missing, NaN or not a number."""
    v = F.nanvl(_as_col(c).try_cast("double"), F.lit(None).cast("double"))
    return v if fill is None else F.coalesce(v, F.lit(float(fill)))


def finite(c: str | Column) -> Column:
    """The value, or NULL for NaN and both infinities."""
    v = to_numeric(c)
    return F.when(F.abs(v) < F.lit(INF), v)


def clean_inf(c: str | Column, fill: float | None = 0.0, clip: bool = False) -> Column:
    v = finite(c)
    if fill is not None:
        v = F.coalesce(v, F.lit(float(fill)))
    return F.greatest(v, F.lit(0.0)) if clip else v


def binary_label(c: str | Column, rule: str = "not_normal") -> Column:
    """1 for attack rows. ``not_normal``: anything but "normal", null included; ``attack_words``: one of the attack words."""
    text = F.lower(F.trim(_as_col(c).cast("string")))
    hit = ~text.eqNullSafe("normal") if rule == "not_normal" else text.isin(ATTACK_WORDS)
    return F.when(hit, 1).otherwise(0)


def hour_angle(hour: Column) -> tuple[Column, Column]:
    turn = F.lit(2.0) * F.pi() * hour / F.lit(24.0)
    return F.sin(turn), F.cos(turn)


def failed_flag(status: str | Column = "status") -> Column:
    return F.when(_as_col(status) == "FAILED", 1).otherwise(0)


def normalise_protocol(c: str | Column) -> Column:
    p = F.upper(_as_col(c).cast("string"))
    return (
        F.when(p.isin("6", "6.0"), "TCP").when(p.isin("17", "17.0"), "UDP").when(p.isin("1", "1.0"), "ICMP").otherwise(p)
    )


def tcp_flag_bits(flags: str | Column = "tcp_flags", protocol: str | Column = "protocol") -> dict[str, Column]:
    """SYN, RST and FIN as 0/1, zero for anything that is not TCP."""
    tcp = _as_col(protocol) == "TCP"

    def bit(mask: int) -> Column:
        return F.when(tcp & (_as_col(flags).bitwiseAND(F.lit(mask)) != 0), 1).otherwise(0)

    return {"syn": bit(2), "rst": bit(4), "fin": bit(1)}


def threat_type(is_anomaly: Column | None = None) -> dict[str, Column]:
    """Attack type and severity of a flow from its core features; benign rows are Normal / Low."""
    # The ladder, first match wins.
    rules = [
        (F.col("syn_flag") > 5, "Port Scan / Recon", "High"),
        ((F.col("total_pkts") > 1000) | (F.col("flow_byts_s") > 5000000), "DDoS Volumetric", "Critical"),
        ((F.col("fwd_bytes") > 1000000) & (F.col("syn_flag") < 2), "Data Exfiltration", "High"),
        ((F.col("pkt_len_mean") < 80) & (F.col("total_pkts") > 50), "Brute Force", "Medium"),
    ]
    return _ladder(rules, ("Suspicious Traffic", "Medium"), ("attack_type", "severity"), is_anomaly, ("Normal", "Low"))


def _ladder(rules, default, names, active: Column | None = None, inactive=None) -> dict[str, Column]:
    out = {}
    for pos, name in enumerate(names):
        expr = None if active is None else F.when(~active, inactive[pos])
        for cond, *values in rules:
            value = values[pos] if isinstance(values[pos], Column) else F.lit(values[pos])
            expr = F.when(cond, value) if expr is None else expr.when(cond, value)
        out[name] = expr.otherwise(default[pos])
    return out


def _z(value: str, stats: str) -> Column:
    spread = F.coalesce(F.col(f"{stats}_std"), F.lit(0.0))
    return (F.col(value) - F.col(f"{stats}_mean")) / F.greatest(F.abs(spread), F.lit(1e-9))


# Features whose normal-class statistics the ladders compare against.
WINDOW_BASELINE = {"ports": "n_dst_ports", "bytes": "n_bytes", "failed": "failed_ratio", "avg": "avg_bytes"}
FLOW_BASELINE = {
    "byts": "flow_byts_s", "pkts": "flow_pkts_s", "fwd": "fwd_bytes",
    "rst": "rst_flag", "syn": "syn_flag", "dur": "flow_duration_s",
}


def classify_window() -> dict[str, Column]:
    """Type and severity of a flagged host window carrying ``<name>_mean`` / ``<name>_std`` baselines."""
    ports, failed = _z("n_dst_ports", "ports"), _z("failed_ratio", "failed")
    volume, avg = _z("n_bytes", "bytes"), _z("avg_bytes", "avg")
    night = F.col("hour").between(0, 5)
    spike = volume > 3
    rules = [
        (ports > 3, "Port Scan", "HIGH"),
        (failed > 2.5, "Brute Force", "HIGH"),
        (spike & (avg > 2), "Data Exfiltration", "CRITICAL"),
        (spike & night, "Night Activity", "CRITICAL"),
        (spike & (volume > 5), "Traffic Spike", "CRITICAL"),
        (spike, "Traffic Spike", "HIGH"),
        (night, "Night Activity", "MEDIUM"),
    ]
    return _ladder(rules, ("Unknown", "LOW"), ("type", "severity"))


def classify_flow() -> dict[str, Column]:
    """Type and severity of a flagged flow; ``total_pkts`` is compared with the mean packet *rate*."""
    byts, pkts, fwd = _z("flow_byts_s", "byts"), _z("flow_pkts_s", "pkts"), _z("fwd_bytes", "fwd")
    rst, syn, dur = _z("rst_flag", "rst"), _z("syn_flag", "syn"), _z("flow_duration_s", "dur")
    rules = [
        ((byts > 4) | (pkts > 4), "DDoS / Flood", "CRITICAL"),
        ((rst > 3) & (syn > 1), "Port Scan", "HIGH"),
        ((rst > 3) & (F.col("total_pkts") < F.col("pkts_mean")), "Brute Force", "HIGH"),
        ((fwd > 3) & (dur > 1), "Data Exfiltration", "CRITICAL"),
        ((dur > 3) & (byts < 0), "Botnet C&C", "MEDIUM"),
    ]
    return _ladder(rules, ("Unknown", "LOW"), ("type", "severity"))


def verdict(pred: str | Column, prob: str | Column, threshold: float = 0.5) -> dict[str, Column]:
    """Anomaly flag (class 1 and confident enough) and the confidence in percent, two places."""
    p = _as_col(prob)
    anomaly = (_as_col(pred) == 1) & (p >= F.lit(float(threshold)))
    return {
        "is_anomaly": F.when(anomaly, 1).otherwise(0),
        "confidence": F.round(F.when(anomaly, p).otherwise(F.lit(1.0) - p) * 100, 2),
    }


def fallback_identity(columns: Sequence[str]) -> dict[str, Column]:
    """Addresses, port and protocol from whichever header exists, else the fixed defaults."""
    # Alternative headers and defaults.
    sources = {
        "src_ip": (["src_ip", "Source IP"], F.lit(DEFAULT_SRC_IP), "string"),
        "dst_ip": (["dst_ip", "Destination IP"], F.lit(DEFAULT_DST_IP), "string"),
        "dst_port": (["dst_port", "Destination Port"], F.lit(0), "int"),
        "protocol": (["protocol", "Protocol"], F.lit("TCP"), "string"),
    }
    out = {}
    for name, (headers, default, dtype) in sources.items():
        present = [col(h).try_cast(dtype) for h in headers if h in columns]
        out[name] = F.coalesce(*present, default) if present else default
    return out


def packet_filter(host: str | None = None, port: int | None = None) -> Column:
    """Packets from or to ``host`` and from or to ``port``."""
    keep = F.lit(True)
    if host:
        keep = keep & ((F.col("src_ip") == host) | (F.col("dst_ip") == host))
    if port:
        keep = keep & ((F.col("src_port") == int(port)) | (F.col("dst_port") == int(port)))
    return keep


def rounded(c: str | Column, places: int = 4) -> Column:
    """``F.round`` of a double, bit by bit, which goes through decimal text only where a plain product cannot decide.

    A product below 2^40 is off by less than 0.001, so its nearest whole number is the right one unless it lies about
    halfway between two; the quotient of two whole numbers is the double next to the decimal. Adding zero drops its sign.
    """
    v, unit = _as_col(c).cast("double"), F.lit(10.0**places)
    scaled = v * unit
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(2.0**40)) & (F.abs(scaled - whole) < F.lit(0.499))
    return F.when(plain, whole / unit + F.lit(0.0)).otherwise(F.round(v, places))


def flow_details(features: Sequence[str] = tuple(CORE_FEATURES)) -> Column:
    """Map of feature values rounded to four places."""
    pairs = []
    for f in features:
        pairs += [F.lit(f), rounded(f)]
    return F.create_map(*pairs)


def display_name(feature: str | Column, names: Mapping[str, str] = DISPLAY_NAMES) -> Column:
    f = _as_col(feature)
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), f), f)


def attribution_to_json(c: str | Column) -> Column:
    return F.to_json(_as_col(c))


def attribution_from_json(c: str | Column) -> Column:
    """Decoded list; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(_as_col(c), IMPACT_TYPE), F.array().cast(IMPACT_TYPE))


def rank_attribution(c: str | Column, by_size: bool = True) -> Column:
    """Contributions by falling (absolute) impact; equal ones keep their order."""
    keyed = F.transform(
        _as_col(c), lambda x, i: F.struct((-F.abs(x["impact"]) if by_size else -x["impact"]).alias("k"), i.alias("i"), x.alias("v"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def explanation_text(c: str | Column, attack_type: str | Column | None = None, in_order: bool = False) -> Column:
    """One sentence naming the up to four strongest contributions above 0.01; ``in_order`` if they are ranked already."""
    ordered = _as_col(c) if in_order else rank_attribution(c, by_size=attack_type is None)
    names = F.slice(
        F.transform(F.filter(ordered, lambda x: x["impact"] > 0.01), lambda x: F.coalesce(x["display_name"], x["feature"])), 1, 4
    )
    n = F.size(names)
    listed = F.when(n == 1, names[0]).otherwise(
        F.concat(
            F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "),
            F.lit(", and "),
            F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("")),
        )
    )
    if attack_type is None:
        sentence = F.concat(F.lit(FLOW_REASON[0]), listed, F.lit(FLOW_REASON[1]))
    else:
        sentence = F.concat(F.lit(RECORD_REASON[0]), _as_col(attack_type), F.lit(RECORD_REASON[1]), listed, F.lit(RECORD_REASON[2]))
    return F.when(n == 0, F.lit(SUBTLE_TEXT)).otherwise(sentence)


def relative_impact(c: str | Column) -> Column:
    """Array of bar widths: absolute impact over the largest one (at least 0.01), in percent."""
    sizes = F.transform(_as_col(c), lambda x: F.abs(x["impact"]))
    top = F.greatest(F.coalesce(F.array_max(sizes), F.lit(0.0)), F.lit(0.01))
    return F.transform(sizes, lambda s: F.least(s / top, F.lit(1.0)) * 100)


def flag_to_label(c: str | Column) -> Column:
    return F.when(_as_col(c) == -1, 1).otherwise(0)


def severity_order(c: str | Column) -> Column:
    expr = None
    for name, pos in SEVERITY_ORDER.items():
        expr = F.when(_as_col(c) == name, pos) if expr is None else expr.when(_as_col(c) == name, pos)
    return expr.otherwise(9)
