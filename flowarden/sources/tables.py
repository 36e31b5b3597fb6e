"""Readers for connection logs, flow exports and connection benchmarks, and the table sinks."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowarden.functions.scalars import col, to_numeric
from flowarden.operators.history import EXPORT_COLUMNS, export_columns
from flowarden.operators.ordered import ranked
from flowarden.sources.captures import read_captures

# Required log columns, capture extensions, benchmark column names.
LOG_COLUMNS = ["timestamp", "src_ip", "dst_ip", "dst_port", "protocol", "bytes", "status", "flags"]
REQUIRED_LOG_COLUMNS = {"timestamp", "src_ip", "dst_ip", "dst_port", "bytes", "status"}
CAPTURE_EXTENSIONS = {".pcap", ".pcapng", ".cap"}
LOG_EXTENSIONS = {".csv", ".log", ".txt"}
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins",
    "logged_in", "num_compromised", "root_shell", "su_attempted",
    "num_root", "num_file_creations", "num_shells", "num_access_files",
    "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate",
    "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty",
]
KDD_CATEGORICAL = ["protocol_type", "service", "flag"]


def conform_conn_log(df: DataFrame) -> DataFrame:
    """Check, default and cast the columns of a connection log read as text."""
    missing = REQUIRED_LOG_COLUMNS - set(df.columns)
    if missing:
        raise ValueError(f"connection log lacks columns: {sorted(missing)}")
    protocol = F.col("protocol") if "protocol" in df.columns else F.lit("TCP")
    return df.select(
        F.col("timestamp").try_cast("timestamp_ntz").alias("timestamp"),
        "src_ip",
        "dst_ip",
        F.col("dst_port").try_cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        to_numeric("bytes", 0).cast("long").alias("bytes"),
        "status",
        F.lit("").alias("flags"),
    )


def read_conn_log(spark: SparkSession, path: str) -> DataFrame:
    return conform_conn_log(spark.read.csv(path, header=True))


def read_flow_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Flow-meter export with a header: every measure a double, ``Label`` an integer, junk NULL.

    Header names come from the first line only; there is no type inference pass.
    """
    text = spark.read.csv(path, header=True)
    kinds = {"Label": "int", "_c0": "long", "Unnamed: 0": "long"}
    out = text.select(*[col(c).try_cast(kinds.get(c, "double")).alias(c) for c in text.columns])
    return out.limit(limit) if limit is not None else out


def read_kdd(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 43-column connection records."""
    kinds = {c: T.StringType() for c in [*KDD_CATEGORICAL, "label"]} | {"difficulty": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in KDD_COLUMNS])
    return spark.read.csv(path, schema=schema)


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """Connection rows from a log or a capture, chosen by the extension."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in CAPTURE_EXTENSIONS:
        return read_captures(spark, path)
    if ext in LOG_EXTENSIONS:
        return read_conn_log(spark, path)
    raise ValueError(f"unsupported file format: {ext or path}")


def profile(df: DataFrame) -> DataFrame:
    """Row and column count."""
    rows = df.agg(F.count(F.lit(1)).alias("num_rows"))
    return rows.withColumn("num_cols", F.lit(len(df.columns)))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows as text, NULL and NaN shown empty."""
    cells = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        cells.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.limit(n).select(*cells)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table (some rows per model) as one CSV, numbers to four places."""
    cols = [F.round(col(f.name), 4).alias(f.name) if isinstance(f.dataType, T.DoubleType) else col(f.name) for f in df.schema.fields]
    df.select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def _history(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no table yet


def append_history(df: DataFrame, path: str, key: str = "id", attribution: str = "contributions", batch: int | None = None, position: str | None = None) -> DataFrame:
    """Append predictions, stamped with the write time, attribution as JSON. Returns the appended rows.

    Stored by day and mode so that paged reads prune. Without ``batch`` ids continue the table's, for a single writer at
    a time. With a batch number, which no other batch of the table may have (from 1 to 2^31 - 1), ids are the batch's own
    range of 2^32: writers never meet, nothing is read to find the last id, and a batch that is there already (a retry)
    is not written again. ``position`` names a column that holds the place of each row, from 1, in the order of the key: the
    rows are then written where they are, without being sorted.
    """
    spark = df.sparkSession
    if batch is None:
        stored = _history(spark, path)
        last = (stored.agg(F.max("id")).first()[0] or 0) if stored is not None else 0
    else:
        if not 0 < batch < 1 << 31:
            raise ValueError(f"batch number out of range: {batch}")
        last, stored = batch << 32, _history(spark, path)
        own = None if stored is None else stored.where(F.col("id").between(last + 1, last + (1 << 32) - 1))
        if own is not None and not own.isEmpty():
            return own.select(*EXPORT_COLUMNS, "shap_explanation", "day")
    now = spark.sql("SELECT current_timestamp() AS t").first()[0]
    stamp = F.lit(now).cast("timestamp")
    numbered = ranked(df, [key], "__pos") if position is None else df.withColumnRenamed(position, "__pos")
    rows = numbered.withColumns(
        {
            "id": F.col("__pos") + F.lit(last),
            "timestamp": F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"),
            "shap_explanation": F.to_json(attribution),
            "day": F.date_format(stamp, "yyyy-MM-dd"),
        }
    )
    out = rows.select(*EXPORT_COLUMNS, "shap_explanation", "day")
    out.write.mode("append").option("compression", "zstd").partitionBy("day", "mode").parquet(path)
    return out


def export_history(df: DataFrame, path: str) -> None:
    export_columns(df).write.mode("overwrite").csv(path, header=True)
