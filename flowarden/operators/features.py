"""Feature mapping and the fit/transform steps. ``fit`` runs aggregates; ``transform`` is one projection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import CORE_FEATURES, LABEL_COLUMNS, binary_label, col, finite, to_numeric
from flowarden.operators.ordered import ranked, ranked_by_hash
from flowarden.operators.quantiles import exact_medians

# Flow-meter headers behind each core feature.
HEADERS = {
    "flow_byts_s": "Flow Byts/s",
    "flow_pkts_s": "Flow Pkts/s",
    "fwd_bytes": "TotLen Fwd Pkts",
    "bwd_bytes": "TotLen Bwd Pkts",
    "syn_flag": "SYN Flag Cnt",
    "rst_flag": "RST Flag Cnt",
    "fin_flag": "FIN Flag Cnt",
    "flow_duration_s": "Flow Duration",
    "pkt_len_mean": "Pkt Len Mean",
}
FWD_COUNT_HEADERS = ["Tot Fwd Pkts", "total_fwd_pkts"]
BWD_COUNT_HEADERS = ["Tot Bwd Pkts", "total_bwd_pkts"]
NON_FEATURES = ["Unnamed: 0", "_c0", "Label", "true_label"]
RATE_FEATURES = ("flow_byts_s", "flow_pkts_s")


def featurise_flows(df: DataFrame, clip: str = "rates", keep: Sequence[str] = ()) -> DataFrame:
    """Raw flow-meter columns to the ten core features; negatives are clipped on the rates or on ``all``."""
    values = {f: to_numeric(h, 0) for f, h in HEADERS.items()}
    values["total_pkts"] = to_numeric(FWD_COUNT_HEADERS[0], 0) + to_numeric(BWD_COUNT_HEADERS[0], 0)
    values["flow_duration_s"] = values["flow_duration_s"] / F.lit(1e6)
    out = []
    for f in CORE_FEATURES:
        v = values[f]
        if clip == "all" or f in RATE_FEATURES:
            v = F.greatest(v, F.lit(0.0))
        out.append(v.alias(f))
    return df.select(*[col(k) for k in keep], *out)


def resolve_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Core features from whichever known header the table has; zero where it has none."""

    def first_of(names):
        return next((c for c in df.columns if c in names), None)

    out = []
    for f in CORE_FEATURES:
        source = first_of([f, HEADERS[f]] if f in HEADERS else [f])
        if source:
            v = to_numeric(source, 0)
            if source == "Flow Duration":
                v = v / F.lit(1e6)
        else:
            fwd, bwd = first_of(FWD_COUNT_HEADERS), first_of(BWD_COUNT_HEADERS)
            both = f == "total_pkts" and fwd and bwd
            v = to_numeric(fwd, 0) + to_numeric(bwd, 0) if both else F.lit(0.0)
        out.append(v.alias(f))
    return df.select(*[col(k) for k in keep], *out)


def label_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.lower() in LABEL_COLUMNS), None)


def with_binary_label(df: DataFrame, rule: str = "attack_words", source: str | None = None, name: str = "y") -> DataFrame:
    source = source or label_column(df)
    if source is None:
        raise ValueError("no label column")
    return df.withColumn(name, binary_label(source, rule))


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every column but the row index, the labels and ``exclude``."""
    drop = {*NON_FEATURES, *exclude}
    return [c for c in df.columns if c not in drop]


def select_features(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*[col(c) for c in feature_columns(df, exclude)])


class Step:
    """A fitted projection: replaces some columns by expressions over themselves."""

    def expressions(self) -> dict[str, Column]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        new = self.expressions()
        return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


@dataclass
class MedianImputer(Step):
    """Missing and infinite values to the median of the *fitted* rows."""

    medians: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> MedianImputer:
        medians = exact_medians(df.select(*[finite(c).alias(c) for c in cols]), cols)
        return cls({c: m if m is not None else 0.0 for c, m in medians.items()})

    def expressions(self):
        return {c: F.coalesce(finite(c), F.lit(m)) for c, m in self.medians.items()}


@dataclass
class SkewLog1p(Step):
    """log(1+x) on the columns whose bias-corrected skewness exceeds the limit."""

    skewed: list[str] = field(default_factory=list)
    skews: dict[str, float | None] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], limit: float = 2.0) -> SkewLog1p:
        row = df.agg(
            *[e for i, c in enumerate(cols) for e in (F.skewness(col(c)).alias(f"s{i}"), F.count(col(c)).alias(f"n{i}"))]
        ).first()
        skews = {}
        for i, c in enumerate(cols):
            g, n = row[2 * i], row[2 * i + 1]
            skews[c] = None if g is None or math.isnan(g) or n < 3 else g * math.sqrt(n * (n - 1)) / (n - 2)
        return cls([c for c in cols if skews[c] is not None and skews[c] > limit], skews)

    def expressions(self):
        return {c: F.log1p(F.greatest(col(c), F.lit(0.0))) for c in self.skewed}


@dataclass
class StandardScale(Step):
    """(x − mean) / population deviation; a constant column is only centred."""

    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> StandardScale:
        row = df.agg(
            *[e for i, c in enumerate(cols) for e in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]
        ).first()
        return cls({c: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, c in enumerate(cols)})

    def expressions(self):
        return {c: (col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()}


def zero_variance_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    row = df.agg(*[F.var_samp(col(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[i] == 0]


def drop_zero_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*zero_variance_columns(df, cols))


def one_hot_sparse(train: DataFrame, test: DataFrame, cats: Sequence[str], name: str = "categories") -> tuple[DataFrame, DataFrame]:
    """One sparse vector of 0/1 entries per row instead of ``cats``, over the values seen in either table; nulls are all 0."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    both = train.select(*[col(c).cast("string").alias(c) for c in cats]).unionByName(test.select(*[col(c).cast("string").alias(c) for c in cats]))
    indexed, encoded = [f"__i_{c}" for c in cats], [f"__v_{c}" for c in cats]
    index = StringIndexer(inputCols=list(cats), outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep").fit(both)
    hot = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="error").fit(index.transform(both))
    join = VectorAssembler(inputCols=encoded, outputCol=name)

    def encode(df: DataFrame) -> DataFrame:
        typed = df.withColumns({c: col(c).cast("string") for c in cats})
        return join.transform(hot.transform(index.transform(typed))).drop(*cats, *indexed, *encoded)

    return encode(train), encode(test)


def one_hot_aligned(train: DataFrame, test: DataFrame, cats: Sequence[str], max_values: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """0/1 columns for each value seen in either table, the same columns on both.

    Column count equals the number of values, so an open-ended column is refused, not truncated: ``one_hot_sparse``
    takes any number.
    """
    values: dict[str, list] = {}
    for c in cats:
        both = train.select(col(c)).union(test.select(col(c))).where(col(c).isNotNull()).distinct()
        rows = both.limit(max_values + 1).collect()
        if len(rows) > max_values:
            raise ValueError(f"column {c} has more than {max_values} values")
        values[c] = sorted(r[0] for r in rows)

    def encode(df: DataFrame) -> DataFrame:
        plain = [col(c) for c in df.columns if c not in cats]
        dummies = [
            F.when(col(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}") for c in cats for v in values[c]
        ]
        return df.select(*plain, *dummies)

    return encode(train), encode(test)


def synth_timestamps(df: DataFrame, order: Sequence[str], base: str = "2024-01-15 00:00:00", span_seconds: int = 86_400, hashed: bool = False) -> DataFrame:
    """Spread the rows evenly over ``span_seconds`` from ``base``, in ``order`` (ending in a unique key).

    ``hashed`` says that ``order`` is an md5 column and the key: rows are then stored in ranges of the hash, which is left out.
    """
    n = df.count()
    numbered = ranked_by_hash(df, *order, n, "__pos") if hashed else ranked(df, order, "__pos")
    micros = F.floor((F.col("__pos") - 1).cast("double") * F.lit(span_seconds * 1_000_000.0 / max(n, 1))).cast("long")
    start = F.lit(base).cast("timestamp")
    return numbered.withColumn(
        "timestamp", F.timestamp_micros(F.unix_micros(start) + micros).cast("timestamp_ntz")
    ).drop("__pos")


def augment_with_score(df: DataFrame, cols: Sequence[str], score: str, name: str = "if_anomaly_score") -> tuple[DataFrame, StandardScale]:
    """Add the anomaly score as one more feature of the same row and rescale all of them together."""
    wide = df.withColumn(name, F.col(score))
    scaler = StandardScale.fit(wide, [*cols, name])
    return scaler.transform(wide), scaler
