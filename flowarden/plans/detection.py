"""Flow detection end to end: training, batch scoring with all report tables, and the streaming job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.functions.scalars import (
    BENIGN_TEXT, IMPACT_TYPE, explanation_text, fallback_identity, flow_details, normalise_protocol, packet_filter, threat_type, verdict,
)
from flowarden.models.attribution import Attributor
from flowarden.models.hybrid import HybridDetector
from flowarden.operators.alerts import count_by, detection_summary, first_of_each, timeline_bins
from flowarden.operators.evaluate import binary_metrics
from flowarden.operators.features import featurise_flows, label_column, resolve_columns, with_binary_label
from flowarden.operators.history import EXPORT_COLUMNS
from flowarden.operators.ordered import ranked, ranked_by_range
from flowarden.operators.sampling import label_union, sample_n
from flowarden.session import materialise, shuffles_freed
from flowarden.sources.tables import append_history
from flowarden.streaming.packets import CONTEXT_SECONDS, per_window_sink, snapshot, stream_flows, window_grid

IDENTITY = ["src_ip", "dst_ip", "dst_port", "protocol"]


def train_hybrid(
    attack: DataFrame, normal: DataFrame, key: str, n: int = 5000, seed: int = 42, path: str | None = None,
    forest_trees: int = 100, trees: int = 100,
) -> HybridDetector:
    """Hybrid detector from flow exports, fitted on at most ``n`` rows of each class drawn from all of them."""
    both = label_union(sample_n(attack, n, seed, key), sample_n(normal, n, seed, key), "y")
    model = HybridDetector.fit(featurise_flows(both, keep=[key, "y"]), label="y", key=key, forest_trees=forest_trees, trees=trees, seed=seed)
    if path:
        model.save(attack.sparkSession, path)
    return model


def score_flows(flows: DataFrame, detector: HybridDetector, threshold: float = 0.5, attribute: Attributor | None = None) -> DataFrame:
    """Core-feature flows with prob, if_score, verdict, attack type and severity.

    With an attributor the flagged rows, and only those, also get contributions and a sentence.
    """
    out = detector.transform(flows, keep_inputs=attribute is not None).withColumns(verdict("pred", "prob", threshold))
    hit = F.col("is_anomaly") == 1
    out = out.withColumns(threat_type(hit))
    if attribute is None:
        return out
    explained = attribute.transform(out, only=hit)  # one pass: a union of both kinds would score every row twice
    sentence = F.when(hit, explanation_text("contributions", in_order=True)).otherwise(F.lit(BENIGN_TEXT))
    return explained.withColumn("explanation_text", sentence).drop(*detector.input_names)


@dataclass
class OfflineReport:
    scored: DataFrame
    summary: DataFrame
    shown: DataFrame
    protocols: DataFrame
    attacks: DataFrame
    timeline: DataFrame
    metrics: DataFrame | None


def offline_detect(
    df: DataFrame, detector: HybridDetector, key: str, threshold: float = 0.5, explain: bool = False, history_path: str | None = None
) -> OfflineReport:
    """Score any table with known flow headers and derive every report table from one stored result.

    For the history the flows are put in the order of their key while they are narrow, before they are scored, so that the
    scored rows are written to it where they are stored. What follows from stored columns alone is not stored.
    """
    spark = df.sparkSession
    identity = fallback_identity(df.columns)
    label = label_column(df)
    named = df.withColumns({f"__id_{c}": e for c, e in identity.items()})
    if label:
        named = with_binary_label(named, "attack_words", label, "__y")
    keep = [key, *[f"__id_{c}" for c in IDENTITY], *(["__y"] if label else [])]
    flows = resolve_columns(named, keep).withColumnsRenamed({f"__id_{c}": c for c in IDENTITY})
    attribute = Attributor(spark, detector.booster.model, detector.input_names, detector.feature_names) if explain else None
    if history_path:
        flows = ranked_by_range(flows, [key], "__pos")
    with shuffles_freed(spark):  # before the history is written
        scored = materialise(score_flows(flows, detector, threshold, attribute), "offline", "zstd").withColumn("flow_details", flow_details())
    if history_path:
        append_history(history_rows(scored, "Offline"), history_path, key, position="__pos")
        scored = scored.drop("__pos")
    return OfflineReport(
        scored,
        detection_summary(scored),
        first_of_each(scored, "is_anomaly", key),
        count_by(scored.select(normalise_protocol("protocol").alias("protocol")), "protocol"),
        count_by(scored.where("is_anomaly = 1"), "attack_type"),
        timeline_bins(scored, [key]),
        binary_metrics(scored, "__y", "is_anomaly") if label else None,
    )


def history_rows(scored: DataFrame, mode: str) -> DataFrame:
    """Scored flows in the shape of the prediction store."""
    out = scored.withColumns({"mode": F.lit(mode), "prediction": F.col("is_anomaly"), "xgb_prob": F.col("prob")})
    return out if "contributions" in out.columns else out.withColumn("contributions", F.array().cast(IMPACT_TYPE))


def online_detect(
    packets: DataFrame, detector: HybridDetector, out: str, seconds: int = CONTEXT_SECONDS, threshold: float = 0.5,
    host: str | None = None, port: int | None = None, explain: bool = False, once: bool = True,
):
    """Streaming job: packets → windowed flows → verdicts → snapshots and history below ``out``.

    Each micro-batch writes its own folders and overwrites them when retried, so a restart neither loses
    nor repeats rows. Windows without packets get zero rows, from the first window to
    the newest one closed.
    """
    spark: SparkSession = packets.sparkSession
    attribute = Attributor(spark, detector.booster.model, detector.input_names, detector.feature_names) if explain else None
    flows = stream_flows(packets.where(packet_filter(host, port)), seconds)

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = materialise(score_flows(batch, detector, threshold, attribute), "online")
        shown, last = scored.select("window"), None
        if batch_id:  # the grid goes on where the batches before ended
            before = spark.read.parquet(f"{out}/snapshots").where(F.col("batch") < batch_id).select("window")
            last = before.agg(F.max("window").alias("window")).where("window IS NOT NULL")
            shown = shown.unionByName(last)
        grid = window_grid(shown, seconds)
        if last is not None:
            grid = grid.join(last, "window", "left_anti")
        snapshot(scored, grid).write.mode("overwrite").parquet(f"{out}/snapshots/batch={batch_id}")
        rows = history_rows(scored, "Online").withColumn("timestamp", F.date_format("window.end", "yyyy-MM-dd HH:mm:ss"))
        keyed = rows.withColumn("row_key", F.concat_ws("|", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"))
        stored = ranked(keyed, ["row_key"], "__pos").withColumn("id", F.col("__pos") + F.lit(batch_id * 2**32))
        stored = stored.withColumn("shap_explanation", F.to_json("contributions")).select(*EXPORT_COLUMNS, "shap_explanation")
        stored.write.mode("overwrite").parquet(f"{out}/history/batch={batch_id}")

    return per_window_sink(flows, handle, f"{out}/checkpoint", once)
