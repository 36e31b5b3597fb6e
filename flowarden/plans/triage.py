"""Host-window triage: profile, score, flag, classify, suppress, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import WINDOW_BASELINE, classify_window
from flowarden.operators.alerts import baseline_stats, count_by, episodes, severity_rank, with_baseline
from flowarden.operators.evaluate import flag_by_contamination
from flowarden.operators.features import StandardScale
from flowarden.operators.threats import enrich_threats
from flowarden.operators.windows import WINDOW_FEATURES, serve_anomalies, traffic_summary, window_features
from flowarden.session import materialise

ALERT_COLUMNS = [
    "timestamp", "src_ip", "type", "severity", "if_score", "n_bytes", "n_packets", "n_dst_ports", "failed_ratio", "hour",
]


def label_windows(flagged: DataFrame) -> DataFrame:
    """Typed alerts of the flagged windows, judged against the unflagged ones."""
    stats = baseline_stats(flagged, WINDOW_BASELINE)
    typed = with_baseline(flagged.where(F.col("if_label") == -1), stats).withColumns(classify_window())
    return typed.withColumn("timestamp", F.col("window")).select(*ALERT_COLUMNS)


def triage(scored: DataFrame, contamination: float = 0.02) -> DataFrame:
    """Ranked episodes from window profiles that carry ``if_score``."""
    scored = materialise(scored, "windows")  # read by the threshold, the baseline and the episode passes
    alerts = label_windows(flag_by_contamination(scored, contamination))
    return severity_rank(materialise(episodes(alerts), "episodes"), ("timestamp", "src_ip", "type"))


def score_windows(conn_log: DataFrame, window: str = "5 minutes", trees: int = 200, seed: int = 42) -> DataFrame:
    """Window profiles with their isolation-forest score."""
    from flowarden.models.iforest import IsolationForest

    profiles = window_features(conn_log, window).withColumn("key", F.concat_ws("|", F.col("window").cast("string"), "src_ip"))
    profiles = materialise(profiles, "profiles")
    scaled = StandardScale.fit(profiles, WINDOW_FEATURES)
    named = {c: f"z_{c}" for c in WINDOW_FEATURES}
    z = profiles.withColumns({named[c]: e for c, e in scaled.expressions().items()})
    forest = IsolationForest(trees=trees, seed=seed).fit(z, list(named.values()), "key")
    return forest.score(z).drop(*named.values(), "key")


def analyze_traffic(conn_log: DataFrame, contamination: float = 0.02, window: str = "5 minutes", trees: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(one-row summary, ranked episodes rounded for serving)."""
    ranked = materialise(triage(score_windows(conn_log, window, trees, seed), contamination), "episodes")
    return traffic_summary(conn_log, ranked), serve_anomalies(ranked)


def threat_report_data(anomalies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their threat context, counts per type)."""
    return enrich_threats(anomalies), count_by(anomalies, "type")
