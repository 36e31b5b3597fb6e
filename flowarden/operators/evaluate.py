"""Detector evaluation: confusion, curves, sweeps, effect sizes, distributions.

In every curve function a *higher* ``score`` means more attack-like; negate isolation-forest scores first.
``label`` is 0/1. Curves are built from counts per distinct score, so ties collapse and no row-level sort
happens; the running counts come from ``ordered.running``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import col
from flowarden.operators.ordered import running
from flowarden.operators.quantiles import exact_quantiles, order_statistics
from flowarden.session import materialise

# Contamination grid of the sweep.
SWEEP = [0.05 + i * 0.05 for i in range(15)]
GUARD = 1e-9


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.agg(
        _n((y == 0) & (p == 0)).alias("tn"),
        _n((y == 0) & (p == 1)).alias("fp"),
        _n((y == 1) & (p == 0)).alias("fn"),
        _n((y == 1) & (p == 1)).alias("tp"),
    )


def binary_metrics(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall, F1 of the attack class; 0/0 is 0."""
    return metrics_from_counts(confusion(df, label, pred)).select("accuracy", "precision", "recall", "f1")


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
        }
    )
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def classification_report(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """Rows Normal, Attack, accuracy, macro avg, weighted avg."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    c = confusion(df, label, pred).withColumns(
        {
            "p0": _ratio(tn, tn + fn), "r0": _ratio(tn, tn + fp), "s0": tn + fp,
            "p1": _ratio(tp, tp + fp), "r1": _ratio(tp, tp + fn), "s1": fn + tp,
            "acc": _ratio(tp + tn, total), "total": total,
        }
    )
    c = c.withColumns({"f0": _f1(F.col("p0"), F.col("r0")), "f1": _f1(F.col("p1"), F.col("r1"))})

    def line(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))

    def macro(k):
        return (F.col(f"{k}0") + F.col(f"{k}1")) / 2

    def weighted(k):
        return _ratio(F.col(f"{k}0") * F.col("s0") + F.col(f"{k}1") * F.col("s1"), F.col("total"))

    acc = F.col("acc")
    rows = F.array(
        line("Normal", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line("Attack", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", acc, acc, acc, F.col("total")),
        line("macro avg", macro("p"), macro("r"), macro("f"), F.col("total")),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("total")),
    )
    return c.select(F.inline(rows))


def per_score_metrics(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Per distinct score, from the highest: own counts (pos, neg), counts at or above it (tp, fp) and rates.

    The rows are read once: counts per score are stored, and class totals and running counts start from them.
    """
    y = F.col(label)
    by_score = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(_n(y == 1).alias("pos"), _n(y == 0).alias("neg"))
    by_score = materialise(by_score.withColumn("__desc", -F.col("threshold")), "per-score")
    pos, neg = (n or 0 for n in by_score.agg(F.sum("pos"), F.sum("neg")).first())
    return running(by_score, ["__desc"], {"tp": "pos", "fp": "neg"}).select(
        "threshold", "pos", "neg", "tp", "fp",
        (F.col("tp") / F.lit(float(max(pos, 1)))).alias("tpr"),
        (F.col("fp") / F.lit(float(max(neg, 1)))).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.lit(float(max(pos, 1))).alias("n_pos"),
        F.lit(float(max(neg, 1))).alias("n_neg"),
    )


def _known_or_made(per_score: DataFrame | None, df: DataFrame, score: str, label: str) -> DataFrame:
    """Several curves of one table can share its ``per_score_metrics``: the rows are then grouped once."""
    return per_score_metrics(df, score, label) if per_score is None else per_score


def roc_curve(df: DataFrame, score: str = "score", label: str = "y", per_score: DataFrame | None = None) -> DataFrame:
    """Points (threshold, fpr, tpr), one per distinct score plus the origin at threshold infinity."""
    pts = _known_or_made(per_score, df, score, label).select("threshold", "fpr", "tpr")
    origin = pts.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def roc_auc(df: DataFrame, score: str = "score", label: str = "y", per_score: DataFrame | None = None) -> DataFrame:
    """Trapezoids between consecutive distinct scores."""
    m = _known_or_made(per_score, df, score, label)
    twice = F.sum(F.col("neg") * (F.lit(2.0) * F.col("tp") - F.col("pos")))
    return m.agg((twice / F.lit(2.0) / F.max("n_pos") / F.max("n_neg")).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "y", per_score: DataFrame | None = None) -> DataFrame:
    """Points (threshold, precision, recall) plus the end point precision 1, recall 0 without a threshold."""
    pts = _known_or_made(per_score, df, score, label).select("threshold", "precision", F.col("tpr").alias("recall"))
    end = pts.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def average_precision(df: DataFrame, score: str = "score", label: str = "y", per_score: DataFrame | None = None) -> DataFrame:
    """Step sum of recall increments times precision."""
    m = _known_or_made(per_score, df, score, label)
    return m.agg(F.sum(F.col("pos") / F.col("n_pos") * F.col("precision")).alias("average_precision"))


def pr_auc_trapezoid(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Area under the precision-recall points joined by straight lines, from (recall 0, precision 1)."""
    m = per_score_metrics(df, score, label)
    prev_n = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    prev = F.when(prev_n > 0, (F.col("tp") - F.col("pos")) / prev_n).otherwise(F.lit(1.0))
    return m.agg(F.sum(F.col("pos") / F.col("n_pos") * (F.col("precision") + prev) / 2).alias("pr_auc"))


def best_f1_threshold(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """The curve point with the largest F1; the lowest threshold wins a tie."""
    m = per_score_metrics(df, score, label)
    p, r = F.col("precision"), F.col("tpr")
    f1 = F.lit(2.0) * p * r / F.greatest(p + r, F.lit(GUARD))
    best = m.agg(F.max_by(F.struct("threshold", "precision", F.col("tpr").alias("recall"), f1.alias("f1")), F.struct(f1, -F.col("threshold"))).alias("b"))
    return best.select("b.*")


def threshold_grid(df: DataFrame, settings: Mapping[float, float], score: str = "score", label: str = "y", below: bool = False) -> DataFrame:
    """True positives, false positives and misses for each setting → threshold, in one pass over the rows.

    Flagged means score at or above the threshold, or at or below it with ``below``. The grid is small and
    known, so it becomes conditional counts instead of a rows × grid join.
    """
    y = F.col(label)
    aggs = [_n(y == 1).alias("pos")]
    for i, t in enumerate(settings.values()):
        hit = F.col(score) <= F.lit(t) if below else F.col(score) >= F.lit(t)
        aggs += [_n(hit & (y == 1)).alias(f"tp{i}"), _n(hit & (y == 0)).alias(f"fp{i}")]
    rows = [
        F.struct(
            F.lit(float(s)).alias("setting"), F.lit(float(t)).alias("threshold"),
            F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("pos") - F.col(f"tp{i}")).alias("fn"),
        )
        for i, (s, t) in enumerate(settings.items())
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def threshold_sweep(df: DataFrame, score: str = "if_score", label: str = "y", contaminations: Sequence[float] = tuple(SWEEP)) -> DataFrame:
    """Precision, recall and F1 when the given shares of lowest scores are flagged."""
    n, stats = order_statistics(df, {score: lambda n: [int(n * c) for c in contaminations]})[score]
    if n == 0:
        return df.sparkSession.createDataFrame([], "contamination double, threshold double, precision double, recall double, f1 double")
    counts = threshold_grid(df, {c: stats[int(n * c)] for c in contaminations}, score, label, below=True)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = tp / (tp + fp + F.lit(GUARD)), tp / (tp + fn + F.lit(GUARD))
    out = counts.select(F.col("setting").alias("contamination"), "threshold", p.alias("precision"), r.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.lit(2.0) * p * r / (p + r + F.lit(GUARD)))


def operating_point(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, label, pred).select(
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(tp, tp + fn).alias("tpr"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp + fn, tn + fp + fn + tp).alias("no_skill"),
    )


def cohens_d(df: DataFrame, cols: Sequence[str], label: str = "y") -> DataFrame:
    """Standardised mean difference attack − normal per column, pooled over population deviations."""
    y = F.col(label)
    one = df.agg(
        *[
            e
            for i, c in enumerate(cols)
            for k in (0, 1)
            for e in (F.avg(F.when(y == k, col(c))).alias(f"m{k}_{i}"), F.var_pop(F.when(y == k, col(c))).alias(f"v{k}_{i}"))
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            (
                (F.col(f"m1_{i}") - F.col(f"m0_{i}"))
                / (F.sqrt((F.col(f"v1_{i}") + F.col(f"v0_{i}")) / 2) + F.lit(GUARD))
            ).alias("cohens_d"),
        )
        for i, c in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*rows)))


def score_stats(df: DataFrame, score: str = "if_score", label: str = "y", flagged: str = "pred") -> DataFrame:
    """Mean, median and sample deviation per class, and the highest score among the flagged rows."""
    split = df.select(*[F.when(F.col(label) == k, F.col(score)).alias(f"c{k}") for k in (0, 1)])
    q = exact_quantiles(split, {"c0": [0.5], "c1": [0.5]})
    boundary = df.agg(F.max(F.when(F.col(flagged) == 1, F.col(score)))).first()[0]
    per = df.groupBy(F.col(label).alias("class")).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    median = F.when(F.col("class") == 1, F.lit(q["c1"][0])).otherwise(F.lit(q["c0"][0]))
    return per.select("class", "mean", median.cast("double").alias("median"), "std", F.lit(boundary).cast("double").alias("boundary"))


def histogram(df: DataFrame, value: str, label: str = "y", edges: int = 60, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts and densities per class over equal bins from ``lo`` to ``hi`` (default: the range of the values). No value, no row."""
    v = F.col(value).cast("double")
    if lo is None or hi is None:
        row = df.agg(F.min(v), F.max(v)).first()
        lo, hi = (row[0] if lo is None else lo), (row[1] if hi is None else hi)
        if lo is None or hi is None:
            lo = hi = 0.0
    bins = edges - 1
    width = (hi - lo) / bins or 1.0
    inside = df.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
    pos = F.floor((v - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float(bins)))
    counts = inside.groupBy(F.col(label).alias("class"), F.least(pos, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = inside.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "class").select(
        "class", "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left_edge"), "n",
        (F.col("n") / (F.col("total") * F.lit(width))).alias("density"),
    )


def winsorised_histogram(df: DataFrame, value: str, label: str = "y", edges: int = 50, cap: float = 0.995, upto: float = 0.99) -> DataFrame:
    """Histogram over 0..p99 of values capped at their class's own ``cap`` quantile."""
    split = df.select(*[F.when(F.col(label) == k, F.col(value)).alias(f"c{k}") for k in (0, 1)])
    q = exact_quantiles(split, {"c0": [cap], "c1": [cap]})
    limit = F.when(F.col(label) == 1, F.lit(q["c1"][0])).otherwise(F.lit(q["c0"][0]))
    capped = df.select(F.col(label), F.least(F.col(value), limit).alias(value))
    top = exact_quantiles(capped, {value: [upto]})[value][0]
    return histogram(capped, value, label, edges, 0.0, 0.0 if top is None else top)


def kde(df: DataFrame, score: str = "if_score", label: str = "y", points: int = 500, bandwidth: float = 0.12, margin: float = 0.01) -> DataFrame:
    """Gaussian density of the scores per class on an even grid.

    Equal scores are merged first; each task then sums its rows' kernels into one vector per class, so
    only ``points`` rows per class and task are shuffled and no row × grid product is ever formed.
    """
    per = df.groupBy(F.col(label).cast("int").alias("class")).agg(
        F.count(score).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.stddev_samp(score).alias("sd")
    )
    grids = {
        r["class"]: (np.linspace(r["lo"] - margin, r["hi"] + margin, points), bandwidth * r["sd"], r["n"])
        for r in per.collect()
        if r["n"] > 1 and r["sd"]
    }
    weights = df.where(F.col(score).isNotNull()).groupBy(F.col(label).cast("int").alias("class"), F.col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("w")
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros(points) for k in grids}
        for pdf in batches:
            for k, part in pdf.groupby("class"):
                if k not in grids:
                    continue
                xs, h, _ = grids[k]
                s, w = part["s"].to_numpy(), part["w"].to_numpy()
                for at in range(0, len(s), 2048):
                    u = (xs[:, None] - s[None, at : at + 2048]) / h
                    sums[k] += np.exp(-0.5 * u * u) @ w[at : at + 2048]
        for k, total in sums.items():
            yield pd.DataFrame({"class": k, "point": np.arange(points), "part": total})

    parts = weights.mapInPandas(partial, "class int, point int, part double")
    shape = [
        (int(k), i, float(x), float(n * h * np.sqrt(2 * np.pi))) for k, (xs, h, n) in grids.items() for i, x in enumerate(xs)
    ]
    axis = df.sparkSession.createDataFrame(shape, "class int, point int, x double, norm double")
    summed = parts.groupBy("class", "point").agg(F.sum("part").alias("total"))
    return summed.join(axis, ["class", "point"]).select("class", "point", "x", (F.col("total") / F.col("norm")).alias("density"))


def box_stats(df: DataFrame, cols: Sequence[str], label: str = "y") -> DataFrame:
    """log(1+x) quartiles, 1.5·IQR whiskers and outlier count per column and class."""
    names = {f"{i}_{k}": (c, k) for i, c in enumerate(cols) for k in (0, 1)}
    wide = df.select(*[F.when(F.col(label) == k, F.log1p(col(c))).alias(n) for n, (c, k) in names.items()])
    quartiles = exact_quantiles(wide, {n: [0.25, 0.5, 0.75] for n in names})
    aggs = []
    for n in names:
        q1, _, q3 = quartiles[n]
        if q1 is None:
            q1 = q3 = 0.0
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        v = F.col(f"`{n}`")
        aggs += [
            F.min(F.when(v >= F.lit(lo), v)).alias(f"lo{n}"),
            F.max(F.when(v <= F.lit(hi), v)).alias(f"hi{n}"),
            _n((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"out{n}"),
        ]
    one = wide.agg(*aggs)
    rows = []
    for n, (c, k) in names.items():
        q1, q2, q3 = (F.lit(v).cast("double") for v in quartiles[n])
        rows.append(
            F.struct(
                F.lit(c).alias("feature"), F.lit(k).alias("class"), q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
                F.least(F.col(f"`lo{n}`"), q1).alias("whisker_lo"), F.greatest(F.col(f"`hi{n}`"), q3).alias("whisker_hi"),
                F.col(f"`out{n}`").alias("outliers"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def percentile_threshold(df: DataFrame, score: str, q: float) -> float | None:
    return exact_quantiles(df, {score: [q]})[score][0]


def contamination(df: DataFrame, label: str = "y", fallback: float = 0.45) -> float:
    share = df.agg(F.avg(label)).first()[0]
    return share if share is not None and 0 < share < 1 else fallback


def flag_by_contamination(df: DataFrame, share: float, score: str = "if_score", name: str = "if_label") -> DataFrame:
    """−1 for rows scoring strictly below the ``share`` quantile, else +1."""
    cut = percentile_threshold(df, score, share)
    return df.withColumn(name, F.when(F.col(score) < F.lit(cut), -1).otherwise(1))


def global_attribution(df: DataFrame, feature: str = "feature", impact: str = "impact", k: int = 10) -> DataFrame:
    mean = df.groupBy(feature).agg(F.avg(F.abs(F.col(impact))).alias("mean_abs_impact"))
    return mean.orderBy(F.desc("mean_abs_impact"), feature).limit(k)


def cv_summary(folds: DataFrame, metric: str = "f1") -> DataFrame:
    return folds.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def score_label_correlation(df: DataFrame, score: str = "if_score", label: str = "y") -> DataFrame:
    return df.agg(F.abs(F.corr(F.col(score), F.col(label).cast("double"))).alias("abs_corr"))


def metric_delta(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, value) tables side by side, with the difference and its direction."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    n = new.select("metric", F.col("value").alias("new"))
    d = F.col("new") - F.col("baseline")
    return b.join(n, "metric").select("metric", "baseline", "new", d.alias("diff"), F.when(d > 0, "^").otherwise("v").alias("direction"))


def evaluation_row(df: DataFrame, name: str, score: str, label: str = "y", pred: str = "pred", trapezoid: bool = False) -> DataFrame:
    """One model's line of the comparison table."""
    counts = metrics_from_counts(confusion(df, label, pred)).first()
    m = per_score_metrics(df, score, label)
    prev_n = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    prev = F.when(prev_n > 0, (F.col("tp") - F.col("pos")) / prev_n).otherwise(F.lit(1.0))
    step = F.col("pos") / F.col("n_pos")
    area = F.sum(step * (F.col("precision") + prev) / 2) if trapezoid else F.sum(step * F.col("precision"))
    twice = F.sum(F.col("neg") * (F.lit(2.0) * F.col("tp") - F.col("pos")))
    return m.agg((twice / F.lit(2.0) / F.max("n_pos") / F.max("n_neg")).alias("roc_auc"), area.alias("pr_auc")).select(
        F.lit(name).alias("model"),
        *[F.lit(counts[c]).alias(c) for c in ("tn", "fp", "fn", "tp")],
        *[F.lit(float(counts[c])).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
        "roc_auc",
        "pr_auc",
    )
