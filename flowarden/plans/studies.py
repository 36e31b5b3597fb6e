"""Evaluation studies over labelled flow exports and connection records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import CORE_FEATURES, FLOW_BASELINE, classify_flow, clean_inf, col, flag_to_label
from flowarden.models.attribution import Attributor
from flowarden.models.compare import ADABOOST, ALL_MODELS, BOOSTED, FOREST, ISOLATION, compare_models, cross_validate
from flowarden.models.hybrid import HybridDetector
from flowarden.models.iforest import IsolationForest
from flowarden.operators import evaluate as E
from flowarden.operators.alerts import baseline_stats, bucket_best, with_baseline
from flowarden.operators.features import (
    MedianImputer, SkewLog1p, StandardScale, feature_columns, featurise_flows, one_hot_aligned, synth_timestamps, with_binary_label,
    zero_variance_columns,
)
from flowarden.operators.sampling import hash_order, label_union, sample_per_class, stratified_split, unused_rows
from flowarden.operators.windows import resample
from flowarden.session import materialise
from flowarden.sources.tables import KDD_CATEGORICAL


@dataclass
class Study:
    """The stored scored rows and the result tables by name; a table that needs fits of its own is made when asked for."""

    scored: DataFrame
    tables: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if callable(self.tables[name]):
            self.tables[name] = self.tables[name]()
        return self.tables[name]


def _balanced(both: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """At most ``n`` rows of each class, drawn from all of them: what a classifier is fitted on."""
    return materialise(sample_per_class(both, n, seed, key, "y"), "sample")


def _forest_scores(df: DataFrame, features: list[str], key: str, share: float, trees: int, seed: int, n: int | None) -> DataFrame:
    """All rows, stored, with if_score, if_label and pred. Scales come from all rows.

    The forest takes its own bounded sample of all rows, or, if ``n`` is given, of ``n`` rows of each class.
    """
    scaled = {f: f"z{i}" for i, f in enumerate(features)}
    names = list(scaled.values())
    scale = {scaled[f]: e for f, e in StandardScale.fit(df, features).expressions().items()}
    rows = df if n is None else _balanced(df, n, key, seed)
    forest = IsolationForest(trees, seed=seed).fit(rows.withColumns(scale), names, key)
    scored = materialise(forest.score(df.withColumns(scale)).drop(*names), "scored")
    flagged = E.flag_by_contamination(scored, share)
    return flagged.withColumns({"pred": flag_to_label("if_label"), "score": -F.col("if_score")})


def flow_report(attack: DataFrame, normal: DataFrame, key: str, n: int | None = None, share: float = 0.40, trees: int = 200, seed: int = 42) -> Study:
    """All flows, shuffled on a one-day clock: typed alerts, best per half hour, quality, series.

    Every statistic covers every row; ``n`` bounds the rows of each class that the forest draws from.
    """
    flows = featurise_flows(label_union(attack, normal, "y"), keep=[key, "y"]).withColumns({f: clean_inf(f) for f in CORE_FEATURES})
    timed = synth_timestamps(flows.withColumn("__h", hash_order(key, seed)), ["__h", key], hashed=True)
    scored = _forest_scores(timed.select(key, "timestamp", "y", *CORE_FEATURES), CORE_FEATURES, key, share, trees, seed, n)
    alerts = with_baseline(scored.where("if_label = -1"), baseline_stats(scored, FLOW_BASELINE)).withColumns(classify_flow())
    series = {
        "byte_rate": ("mean", "flow_byts_s"), "packets": ("sum", "total_pkts"), "resets": ("sum", "rst_flag"), "worst_score": ("min", "if_score"),
    }
    return Study(
        scored,
        {
            "alerts": bucket_best(alerts.select(key, "timestamp", "type", "severity", "if_score", *CORE_FEATURES, "y"), tie=(key,)),
            "report": E.classification_report(scored),
            "confusion": E.confusion(scored),
            "series": resample(scored, "timestamp", "5 minutes", series),
        },
    )


def dataset_comparison(attack: DataFrame, normal: DataFrame, key: str, features: list[str], n: int | None = None, share: float = 0.40, trees: int = 200, seed: int = 42) -> Study:
    """Forest quality plus the class-difference tables behind the charts, all over every row; ``n`` as in ``flow_report``."""
    both = label_union(attack, normal, "y")
    clean = materialise(both.select(col(key), "y", *[clean_inf(f, 0, True).alias(f) for f in features]), "clean")
    scored = _forest_scores(clean, features, key, share, trees, seed, n)
    points = E.per_score_metrics(scored)
    tables = {
        "report": E.classification_report(scored), "roc": E.roc_curve(scored, per_score=points), "roc_auc": E.roc_auc(scored, per_score=points),
        "pr": E.pr_curve(scored, per_score=points), "average_precision": E.average_precision(scored, per_score=points), "sweep": E.threshold_sweep(scored), "operating_point": E.operating_point(scored),
        "cohens_d": E.cohens_d(scored, features), "score_stats": E.score_stats(scored), "kde": E.kde(scored),
        "box": E.box_stats(scored, features[:4]),
    }
    tables |= {f"histogram:{f}": E.winsorised_histogram(scored.select("y", col(f).alias("v")), "v") for f in features[:4]}
    return Study(scored, tables)


def all_feature_run(
    attack: DataFrame, normal: DataFrame, key: str, baseline: DataFrame | None = None, n: int | None = None, share: float = 0.40, trees: int = 200, seed: int = 42
) -> Study:
    """Forest over every usable column, compared with a baseline (metric, value) table.

    Medians, variances, skewness and scales come from all rows, and all are scored; ``n`` as in ``flow_report``.
    """
    both = label_union(attack, normal, "y")
    features = feature_columns(both, [key, "y", "label"])
    filled = materialise(MedianImputer.fit(both, features).transform(both), "filled")
    constant = set(zero_variance_columns(filled, features))
    features = [f for f in features if f not in constant]
    x = materialise(SkewLog1p.fit(filled, features).transform(filled).drop(*constant), "features")
    scored = _forest_scores(x, features, key, share, trees, seed, n)
    tables = {
        "report": E.classification_report(scored), "best_threshold": E.best_f1_threshold(scored), "histogram": E.histogram(scored, "if_score"),
        "cohens_d": E.cohens_d(scored, features), "correlation": E.score_label_correlation(scored),
    }
    if baseline is not None:
        metrics = E.binary_metrics(scored).unpivot([], ["precision", "recall", "f1", "accuracy"], "metric", "value")
        tables["delta"] = E.metric_delta(baseline, metrics)
    return Study(scored, tables)


def rigorous_eval(
    attack: DataFrame, normal: DataFrame, key: str, n: int = 10_000, k: int = 5, forest_trees: int = 150, trees: int = 100, rounds: int = 50, seed: int = 42
) -> Study:
    """60/20/20 split before anything is fitted; cross-validation on the training part; all models on test and unseen.

    ``n`` rows of each class are split; all rows outside the sample are unseen too, so every row that no model was
    fitted on is scored.
    """
    whole = label_union(attack, normal, "y")
    both = _balanced(whole, n, key, seed)
    features = feature_columns(both, [key, "y", "label"])
    split = materialise(stratified_split(both, [0.6, 0.2, 0.2], "y", key, seed), "split")
    train, test, unseen = (split.where(F.col("split") == i) for i in range(3))
    unseen = unseen.drop("split").unionByName(unused_rows(whole, split, key))

    @cache
    def folds() -> tuple[DataFrame, DataFrame]:
        return cross_validate(train, features, k, key=key, trees=trees, seed=seed)

    @cache
    def compared() -> tuple[DataFrame, HybridDetector]:
        return compare_models(
            train, {"test": test, "unseen": unseen}, features, key=key, forest_trees=forest_trees, trees=trees, rounds=rounds, seed=seed, augment_scaled=False
        )

    def top_features() -> DataFrame:
        hybrid = compared()[1]
        attribute = Attributor(split.sparkSession, hybrid.booster.model, hybrid.input_names, hybrid.feature_names)
        impacts = attribute.transform(hybrid.transform(test, keep_inputs=True)).select(F.inline("contributions"))
        return E.global_attribution(impacts)

    return Study(split, {"folds": lambda: folds()[0], "cv": lambda: folds()[1], "metrics": lambda: compared()[0], "top_features": top_features})


def kdd_eval(train: DataFrame, test: DataFrame, key: str, forest_trees: int = 100, trees: int = 100, rounds: int = 100, seed: int = 42, models=ALL_MODELS) -> DataFrame:
    """Connection records: categories as aligned 0/1 columns, all models, precision-recall area by trapezoids."""
    train, test = (with_binary_label(df, "not_normal", "label").drop("label", "difficulty") for df in (train, test))
    cats = [c for c in KDD_CATEGORICAL if c in train.columns]
    train, test = one_hot_aligned(train, test, cats)
    features = [c for c in train.columns if c not in (key, "y")]
    metrics, _ = compare_models(
        train, {"test": test}, features, key=key, models=models, forest_trees=forest_trees, trees=trees, rounds=rounds, seed=seed, trapezoid=True
    )
    return metrics


def algorithm_comparison(attack: DataFrame, normal: DataFrame, key: str, n: int = 10_000, forest_trees: int = 200, trees: int = 100, rounds: int = 50, seed: int = 42) -> DataFrame:
    """Core features, 80/20 split of ``n`` rows of each class, the four single models; rows outside the sample are ``unseen``."""
    flows = featurise_flows(label_union(attack, normal, "y"), "all", keep=[key, "y"]).withColumns({f: clean_inf(f) for f in CORE_FEATURES})
    flows = materialise(flows, "flows")
    split = materialise(stratified_split(_balanced(flows, n, key, seed), [0.8, 0.2], "y", key, seed), "split")
    metrics, _ = compare_models(
        split.where("split = 0"), {"test": split.where("split = 1"), "unseen": unused_rows(flows, split, key)}, CORE_FEATURES, key=key, models=(ISOLATION, ADABOOST, BOOSTED, FOREST),
        log=False, forest_trees=forest_trees, trees=trees, rounds=rounds, seed=seed,
    )
    return metrics
