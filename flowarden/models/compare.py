"""Side-by-side evaluation of detectors, with every statistic fitted on training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import col
from flowarden.models.hybrid import HybridDetector, Preprocessor
from flowarden.models.iforest import IsolationForest
from flowarden.models.supervised import fit_adaboost, fit_boosted_trees, fit_random_forest
from flowarden.operators.evaluate import confusion, contamination, cv_summary, evaluation_row, metrics_from_counts, percentile_threshold
from flowarden.operators.sampling import stratified_folds
from flowarden.session import CONCURRENT, concurrently, materialise

ISOLATION, ADABOOST, BOOSTED, FOREST, HYBRID = "Isolation Forest", "AdaBoost", "Boosted Trees", "Random Forest", "Hybrid"
ALL_MODELS = (ISOLATION, ADABOOST, BOOSTED, FOREST, HYBRID)


def compare_models(
    train: DataFrame, evals: Mapping[str, DataFrame], features: Sequence[str], label: str = "y", key: str = "flow_id",
    models: Sequence[str] = ALL_MODELS, log: bool = True, forest_trees: int = 100, trees: int = 100, rounds: int = 50,
    seed: int = 42, augment_scaled: bool = True, trapezoid: bool = False, at_once: int = CONCURRENT,
) -> tuple[DataFrame, HybridDetector | None]:
    """(one row of metrics per model and evaluation set, the fitted hybrid if asked for); ``at_once`` models are fitted together."""
    needed = list(dict.fromkeys([*features, label, key]))
    train = materialise(train.select(*[col(c) for c in needed]), "train")
    evals = {n: materialise(e.select(*[col(c) for c in needed]), "eval") for n, e in evals.items()}
    pre = Preprocessor.fit(train, features, log)
    z_train = materialise(pre.transform(train).select(*pre.names, label, key), "z_train")
    z_evals = {n: pre.transform(e).select(*pre.names, label, key) for n, e in evals.items()}

    def evaluate(name: str, predicted: Mapping[str, DataFrame], score: str = "prob") -> list[DataFrame]:
        judged = {n: materialise(p.select(label, "pred", score), "predicted") for n, p in predicted.items()}
        return [materialise(evaluation_row(p, name, score, label, "pred", trapezoid).withColumn("eval_set", F.lit(n)), "metrics") for n, p in judged.items()]

    def isolation() -> tuple[list[DataFrame], None]:
        forest = IsolationForest(forest_trees, seed=seed).fit(z_train, pre.names, key)
        share = contamination(train, label)
        # scores are positive here, so the attack share lies above the 1 − share quantile
        cut = percentile_threshold(materialise(forest.score(z_train, "prob", negate=True).select("prob"), "scores"), "prob", 1 - share)
        flag = F.when(F.col("prob") >= F.lit(cut), 1).otherwise(0)
        return evaluate(ISOLATION, {n: forest.score(z, "prob", negate=True).withColumn("pred", flag) for n, z in z_evals.items()}), None

    def with_hybrid() -> tuple[list[DataFrame], HybridDetector]:
        model = HybridDetector.fit(train, features, label, key, forest_trees, trees, seed=seed, augment_scaled=augment_scaled)
        return evaluate(HYBRID, {n: model.transform(e) for n, e in evals.items()}), model

    def supervised(name: str) -> tuple[list[DataFrame], None]:
        fit = {
            ADABOOST: lambda: fit_adaboost(z_train, pre.names, label, rounds),
            BOOSTED: lambda: fit_boosted_trees(z_train, pre.names, label, trees),
            FOREST: lambda: fit_random_forest(z_train, pre.names, label, trees, seed=seed),
        }[name]
        model = fit()
        return evaluate(name, {n: model.predict(z) for n, z in z_evals.items()}), None

    steps = {ISOLATION: isolation, HYBRID: with_hybrid}
    done = concurrently(train.sparkSession, [steps.get(name) or partial(supervised, name) for name in models], at_once)
    hybrid = next((model for _, model in done if model), None)
    return reduce(DataFrame.unionByName, [row for rows, _ in done for row in rows]), hybrid


def cross_validate(
    df: DataFrame, features: Sequence[str], k: int = 5, label: str = "y", key: str = "flow_id",
    forest_trees: int = 100, trees: int = 100, seed: int = 42, augment_scaled: bool = False, at_once: int = CONCURRENT,
) -> tuple[DataFrame, DataFrame]:
    """(metrics and confusion cells per fold, mean and deviation of F1); everything is refitted on each fold's training part.

    A fold is fitted on all rows of the others, and every row is held out once and scored.
    ``at_once`` folds are fitted together; the table is that of one after the other.
    """
    folded = materialise(stratified_folds(df.select(*[col(c) for c in dict.fromkeys([*features, label, key])]), k, label, key, seed), "folds")

    def judged(i: int) -> DataFrame:
        model = HybridDetector.fit(folded.where(F.col("fold") != i), features, label, key, forest_trees, trees, seed=seed, augment_scaled=augment_scaled)
        held = model.transform(folded.where(F.col("fold") == i))
        return materialise(metrics_from_counts(confusion(held, label)).withColumn("fold", F.lit(i)), "fold_metrics")

    folds = reduce(DataFrame.unionByName, concurrently(df.sparkSession, [partial(judged, i) for i in range(k)], at_once))
    return folds, cv_summary(folds)
