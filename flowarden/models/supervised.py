"""Supervised detectors on a common footing: ``fit(df, cols, label)`` → model with ``predict(df)`` adding prob and pred."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.functions.scalars import col
from flowarden.models.histogram import HELD_ROWS, TASK_ROWS, NodeTrees, fit_boosted, fit_forest, fit_stumps
from flowarden.session import spread


@dataclass
class TreeEnsemble:
    """Fitted trees with their input columns."""

    model: NodeTrees
    cols: list[str]

    def predict(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        inputs = [col(c).cast("double") for c in self.cols]
        out = spread(df).withColumn(prob, self.model.probability(df.sparkSession, inputs))
        return out.withColumn(pred, F.when(F.col(prob) > 0.5, 1).otherwise(0))


def fit_random_forest(df: DataFrame, cols: Sequence[str], label: str, trees: int = 100, seed: int = 42, held_rows: int = HELD_ROWS) -> TreeEnsemble:
    """Fully grown trees on bootstrap draws from all rows; a task holds at most ``held_rows`` different ones in memory."""
    return TreeEnsemble(fit_forest(df, cols, label, trees, seed, held_rows), list(cols))


def fit_boosted_trees(df: DataFrame, cols: Sequence[str], label: str, trees: int = 100, depth: int = 6, rate: float = 0.1, task_rows: int = TASK_ROWS) -> TreeEnsemble:
    """Second-order boosting with ridge-regularised leaves; nothing in it is drawn at random."""
    return TreeEnsemble(fit_boosted(df, cols, label, trees, depth, rate, task_rows=task_rows), list(cols))


@dataclass
class AdaBoostModel:
    """Weighted stumps (feature, threshold, class at or below it, class above it, weight): pure expressions."""

    cols: list[str]
    stumps: list[tuple[int, float, float, float, float]]

    @staticmethod
    def _vote(value: Column, threshold: float, left: float, right: float) -> Column:
        return F.when(value <= F.lit(threshold), F.lit(left)).otherwise(F.lit(right))

    def predict(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        total, decision = sum(s[4] for s in self.stumps) or 1.0, F.lit(0.0)
        for f, threshold, left, right, weight in self.stumps:
            vote = self._vote(col(self.cols[f]), threshold, 2 * left - 1, 2 * right - 1)
            decision = decision + vote * F.lit(weight / total)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-decision))
        return df.withColumn(prob, p).withColumn(pred, F.when(F.col(prob) > 0.5, 1).otherwise(0))


def fit_adaboost(df: DataFrame, cols: Sequence[str], label: str, rounds: int = 50, rate: float = 1.0, task_rows: int = TASK_ROWS) -> AdaBoostModel:
    """SAMME on depth-one trees."""
    return AdaBoostModel(list(cols), fit_stumps(df, cols, label, rounds, rate, task_rows))
