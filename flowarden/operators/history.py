"""Prediction history: paging, lookups, settings, logs, snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import attribution_from_json, explanation_text
from flowarden.operators.ordered import between

PLAIN_PAGE_ROWS = 10_000  # pages that end before this row are a plain top-n

# Columns a page may sort by, exported columns, settings defaults.
SORT_COLUMNS = ["timestamp", "mode", "src_ip", "dst_ip", "protocol", "dst_port", "prediction", "confidence", "attack_type"]
EXPORT_COLUMNS = [
    "id", "timestamp", "mode", "src_ip", "dst_ip", "protocol", "dst_port",
    "prediction", "confidence", "attack_type", "if_score", "xgb_prob",
]
DEFAULT_SETTINGS = {
    "context_window": "30",
    "model_selection": "Hybrid Model",
    "confidence_threshold": "0.5",
    "packet_capture_interface": "",
    "auto_refresh": "true",
    "dark_mode": "true",
}


def _matching(df: DataFrame, search=None, mode=None, prediction=None, protocol=None) -> DataFrame:
    if search:
        pattern = f"%{search}%"
        df = df.where(F.col("src_ip").ilike(pattern) | F.col("dst_ip").ilike(pattern) | F.col("attack_type").ilike(pattern))
    if mode:
        df = df.where(F.col("mode") == mode)
    if prediction is not None:
        df = df.where(F.col("prediction") == int(prediction))
    if protocol:
        df = df.where(F.col("protocol") == protocol)
    return df


def history_page(
    df: DataFrame, search: str | None = None, mode: str | None = None, prediction: int | None = None, protocol: str | None = None,
    limit: int = 25, offset: int = 0, sort_by: str = "timestamp", sort_order: str = "DESC",
    after: tuple | None = None, plain_rows: int = PLAIN_PAGE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """One page of matching records and a one-row table with the total number of matches.

    ``after`` (sort value and id of the last record seen) starts behind that record instead of at ``offset``; such a page
    costs one filtered scan however far it lies. Offsets beyond ``plain_rows`` are found by counting key ranges.
    """
    sort_by = sort_by if sort_by in SORT_COLUMNS else "timestamp"
    sort_order = sort_order.upper() if sort_order.upper() in ("ASC", "DESC") else "DESC"
    hits = _matching(df, search, mode, prediction, protocol)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    rising = sort_order == "ASC"
    order = F.asc(sort_by) if rising else F.desc(sort_by)
    if after is not None:
        return hits.where(_behind(sort_by, rising, *after)).orderBy(order, "id").limit(limit), total
    if offset + limit <= plain_rows:
        return hits.orderBy(order, "id").offset(offset).limit(limit), total
    if rising:
        return between(hits, [sort_by, "id"], offset, limit, plain_rows), total
    # falling values with rising ids are the mirror image of rising values with falling ids
    end = max(0, total.first()["total"] - offset)
    start = max(0, end - limit)
    page = between(hits.withColumn("__falling", -F.col("id")), [sort_by, "__falling"], start, end - start, plain_rows)
    return page.drop("__falling").orderBy(order, "id"), total


def _behind(sort_by: str, rising: bool, value, record_id: int) -> Column:
    """Whether a record comes after the given one; missing values come first among rising and last among falling ones."""
    c = F.col(sort_by)
    same = c.eqNullSafe(F.lit(value)) & (F.col("id") > record_id)
    if value is None:
        return same | c.isNotNull() if rising else same
    return same | (c > F.lit(value)) if rising else same | (c < F.lit(value)) | c.isNull()


def export_columns(df: DataFrame) -> DataFrame:
    return df.select(*EXPORT_COLUMNS)


def latest(df: DataFrame, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc("id")).limit(n)


def record_attribution(df: DataFrame, record_id: int, attribution: str = "shap_explanation") -> DataFrame:
    """One record's attack type, decoded contributions and explanation sentence."""
    one = df.where(F.col("id") == record_id).withColumn("contributions", attribution_from_json(attribution))
    return one.select("id", "attack_type", "contributions", explanation_text("contributions", "attack_type").alias("text_explanation"))


def latest_per_key(writes: DataFrame, key: str = "key", value: str = "value", order: str = "id", defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Last written value per key; ``defaults`` fill keys never written."""
    current = writes.groupBy(key).agg(F.max_by(value, order).alias(value))
    if not defaults:
        return current
    base = writes.sparkSession.createDataFrame(list(defaults.items()), f"{key} string, __default string")
    return current.join(base, key, "full").select(key, F.coalesce(value, "__default").alias(value))


def setting(writes: DataFrame, name: str, default: str | None = None) -> DataFrame:
    """One row: the last value written under ``name``, else ``default``."""
    return writes.where(F.col("key") == name).agg(F.coalesce(F.max_by("value", "id"), F.lit(default)).alias("value"))


def last_n_snapshots(df: DataFrame, n: int = 30, order: str = "window") -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)
