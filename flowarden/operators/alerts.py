"""Alert post-processing: episodes, per-bucket best, ranking, counts, timelines, top-k, baselines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowarden.functions.scalars import severity_order
from flowarden.operators.ordered import ranked, run_totals

EPISODE_GAP = 15 * 60  # fixed value: seconds within which alerts of one type belong together


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def episodes(
    df: DataFrame,
    gap_seconds: int = EPISODE_GAP,
    ts: str = "timestamp",
    score: str = "if_score",
    type_col: str = "type",
    tie: Sequence[str] = ("src_ip",),
) -> DataFrame:
    """Collapse alerts of one type: an alert within the gap of the episode's representative joins it, and
    replaces it if its score is strictly lower; otherwise the episode closes and a new one starts.

    The rule is sequential, but it need not run over a whole type. (1) Of the rows at one instant only the
    lowest-scoring can become representative. (2) A row scoring below everything in the gap before it is
    the representative whatever came earlier, so the sequence is cut there into independent segments, and
    only the row that ends a segment looks back at it. Both are found with aggregates and windows over
    (type, time bucket), each bucket seeing one gap of its predecessor. The fold over a segment then
    streams through sorted partitions with one row of state.
    """
    gap = max(gap_seconds * 1_000_000, 1)
    bucket = 16 * gap
    # plain, never-null keys let the later steps reuse each other's partitioning
    keyed = df.withColumns({"__type": F.coalesce(F.col(type_col).cast("string"), F.lit("\0")), "__t": _micros(ts)})
    best = keyed.groupBy("__type", "__t").agg(
        F.min(score).alias("__s"), F.min_by(F.struct(*df.columns), F.struct(score, *tie)).alias("__row")
    )

    def slot(t: Column, width: int) -> Column:
        return F.floor(t / F.lit(width)).cast("long")

    # each row in its bucket, and again (as look-back only) in the next one if the gap reaches there
    t = F.col("__t")
    home = slot(t, bucket)
    spread = best.select("__type", "__t", "__s", F.explode(F.array_distinct(F.array(home, slot(t + gap, bucket)))).alias("__b"))
    spread = spread.repartition("__type", "__b")
    at_home = F.col("__b") == home
    # Lowest score in [t − gap, t): the part in t's own gap-wide block is a running minimum; the part in the
    # block before is asked for by a probe placed at t − gap, answered by a running minimum from that block's
    # end. Both are linear, however many rows share a gap, and need no further shuffle.
    data = F.struct(F.lit(0).alias("probe"), t.alias("at"), F.col("__s").alias("s"))
    probe = F.struct(F.lit(1).alias("probe"), (t - gap).alias("at"), F.lit(None).cast(best.schema["__s"].dataType).alias("s"))
    points = spread.select("__type", "__b", "__t", "__s", F.explode(F.when(at_home, F.array(data, probe)).otherwise(F.array(data))).alias("p"))
    points = points.select("__type", "__b", "__t", "__s", "p.*").withColumn("block", slot(F.col("at"), gap))
    block = Window.partitionBy("__type", "__b", "block")
    before = F.min("s").over(block.orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("s").over(block.orderBy(F.desc("at"), "probe").rowsBetween(Window.unboundedPreceding, 0))
    seen = points.withColumns({"__before": before, "__after": after}).groupBy("__type", "__b", "__t").agg(
        F.first("__s").alias("__s"), F.min(F.when(F.col("probe") == 0, F.col("__before")).otherwise(F.col("__after"))).alias("__low")
    )
    starts = seen.where(at_home).withColumn(
        "__start", F.when(F.col("__low").isNull() | (F.col("__s") < F.col("__low")), F.col("__t"))
    )
    by_time = Window.partitionBy("__type", "__b").orderBy("__t")
    marked = starts.withColumns(
        {
            "__own": F.last("__start", True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)),
            "__prev": F.last("__start", True).over(by_time.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    # the segment open at the end of a bucket reaches into the following ones; one row per type and bucket
    ends = starts.groupBy("__type", "__b").agg(F.max("__start").alias("__end"))
    carry = ends.select(
        F.col("__type").alias("__ct"),
        F.col("__b").alias("__cb"),
        F.last("__end", True).over(Window.partitionBy("__type").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"),
    )
    placed = marked.join(carry, (F.col("__type") == F.col("__ct")) & (F.col("__b") == F.col("__cb")), "left")
    own, prev = F.coalesce("__own", "__carry"), F.coalesce("__prev", "__carry")
    member = F.struct(own.alias("seg"), F.lit(False).alias("closes"))
    closer = F.struct(prev.alias("seg"), F.lit(True).alias("closes"))
    pieces = placed.select(
        "__type", "__t", "__s",
        F.explode(F.when(F.col("__start").isNotNull() & prev.isNotNull(), F.array(member, closer)).otherwise(F.array(member))).alias("p"),
    ).select("__type", "__t", "__s", F.col("p.seg").alias("__seg"), F.col("p.closes").alias("__closes"))

    keys = "__type string, __t long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, rep, rep_t, rep_s = None, None, 0, 0.0
        for pdf in batches:
            out = []
            for typ, t, s, seg, closes in zip(pdf["__type"], pdf["__t"], pdf["__s"], pdf["__seg"], pdf["__closes"]):
                if (typ, seg) != segment:
                    if rep is not None:
                        out.append(rep)
                    segment, rep, rep_t, rep_s = (typ, seg), (typ, t), t, s
                elif t - rep_t > gap:
                    out.append(rep)
                    rep, rep_t, rep_s = (None if closes else (typ, t)), t, s
                elif closes:
                    rep = None
                elif s < rep_s:
                    rep, rep_t, rep_s = (typ, t), t, s
            if out:
                yield pd.DataFrame(out, columns=["__type", "__t"])
        if rep is not None:
            yield pd.DataFrame([rep], columns=["__type", "__t"])

    kept = (
        pieces.repartition("__type", "__seg")
        .sortWithinPartitions("__type", "__seg", "__t")
        .mapInPandas(fold, keys)
    )
    kept = kept.select(F.col("__type").alias("__kt"), F.col("__t").alias("__kk"))
    out = best.join(kept, (F.col("__type") == F.col("__kt")) & (F.col("__t") == F.col("__kk")), "left_semi")
    return out.select("__row.*")


def bucket_best(
    df: DataFrame, width: str = "30 minutes", ts: str = "timestamp", score: str = "if_score", type_col: str = "type", tie: Sequence[str] = ()
) -> DataFrame:
    """The lowest-scoring alert per type and time bucket; the earliest wins a tie."""
    row = F.struct(*df.columns)
    order = F.struct(F.col(score), F.col(ts), *[F.col(c) for c in tie])
    best = df.groupBy(type_col, F.window(ts, width).alias("__w")).agg(F.min_by(row, order).alias("r"), F.col("__w.start").alias("bucket"))
    return best.select("r.*", "bucket")


def severity_rank(df: DataFrame, then: Sequence[str] = ("timestamp",), name: str = "rank") -> DataFrame:
    """Number alerts by severity, then by ``then`` (ending in a unique key)."""
    keyed = df.withColumn("__sev", severity_order("severity"))
    return ranked(keyed, ["__sev", *then], name).drop("__sev")


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def known_unknown(df: DataFrame, type_col: str = "type") -> DataFrame:
    unknown = F.count(F.when(F.col(type_col) == "Unknown", 1))
    return df.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - unknown).alias("known"), unknown.alias("unknown"))


def detection_summary(df: DataFrame, flag: str = "is_anomaly", prob: str = "prob", score: str = "if_score") -> DataFrame:
    n, hits = F.count(F.lit(1)), F.coalesce(F.sum(flag), F.lit(0))
    return df.agg(
        n.alias("total_flows"),
        hits.alias("anomalies"),
        (n - hits).alias("normal"),
        F.when(n > 0, hits / n * 100).otherwise(0.0).alias("threat_ratio"),
        F.avg(prob).alias("mean_prob"),
        F.avg(score).alias("mean_score"),
    )


def timeline_bins(df: DataFrame, order: Sequence[str], flag: str = "is_anomaly", bins: int = 12, include_tail: bool = True) -> DataFrame:
    """Consecutive equal runs of rows in ``order``; the last run also takes the remainder unless ``include_tail`` is off."""
    size = max(1, df.count() // bins)
    counted = run_totals(df.select(*order, flag), order, size, {"attacks": flag}, bins, include_tail).withColumn("bin", F.col("run").cast("int"))
    return counted.select(
        "bin", (F.col("total") - F.col("attacks")).alias("normal"), "attacks", F.round(F.col("attacks") / F.col("total") * 100, 2).alias("detection_rate")
    )


def baseline_stats(df: DataFrame, baseline: dict[str, str], flag: str = "if_label") -> DataFrame:
    """One row: mean and sample deviation of the chosen features among unflagged rows."""
    normal = df.where(F.col(flag) == 1)
    return normal.agg(
        *[e for n, c in baseline.items() for e in (F.avg(c).alias(f"{n}_mean"), F.stddev_samp(c).alias(f"{n}_std"))]
    )


def with_baseline(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the single statistics row to every row, as literals."""
    row = stats.first()
    return df.withColumns({c: F.lit(row[c]).cast(stats.schema[c].dataType) for c in stats.columns})


def top_talkers(df: DataFrame, ip: str, k: int = 5) -> DataFrame:
    return df.groupBy(F.col(ip).alias("ip")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ip").limit(k)


def top_alerts(df: DataFrame, k: int = 25, by: str = "confidence", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(k)


def first_of_each(df: DataFrame, flag: str, order: str, k: int = 50) -> DataFrame:
    """The first ``k`` flagged and the first ``k`` unflagged rows."""
    hits = df.where(F.col(flag) == 1).orderBy(order).limit(k)
    return hits.unionByName(df.where(F.col(flag) == 0).orderBy(order).limit(k))
