"""Anomaly score + boosted trees: one fitted object from raw features to class, probability and score."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.functions.scalars import CORE_FEATURES, col
from flowarden.models.iforest import IsolationForest, IsolationForestModel
from flowarden.models.histogram import NodeTrees
from flowarden.models.supervised import TreeEnsemble, fit_boosted_trees
from flowarden.operators.features import MedianImputer, SkewLog1p, StandardScale
from flowarden.session import materialise

SCORE_FEATURE = "if_anomaly_score"


@dataclass
class Preprocessor:
    """Impute → log1p → scale, fitted on the training rows only. Works on columns ``x0, x1, …``."""

    features: list[str]
    imputer: MedianImputer
    log: SkewLog1p
    scaler: StandardScale

    @property
    def names(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.features))]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], log: bool = True) -> Preprocessor:
        names = [f"x{i}" for i in range(len(features))]
        x = df.select(*[col(f).try_cast("double").alias(n) for f, n in zip(features, names)])
        imputer = MedianImputer.fit(x, names)
        x = imputer.transform(x)
        skew = SkewLog1p.fit(x, names) if log else SkewLog1p()
        return cls(list(features), imputer, skew, StandardScale.fit(skew.transform(x), names))

    def transform(self, df: DataFrame, scale: bool = True) -> DataFrame:
        """Add the cleaned columns; a feature the table lacks reads as its median."""
        have = set(df.columns)
        added = {n: col(f).try_cast("double") if f in have else F.lit(None).cast("double") for f, n in zip(self.features, self.names)}
        out = self.log.transform(self.imputer.transform(df.withColumns(added)))
        return self.scaler.transform(out) if scale else out


@dataclass
class HybridDetector:
    """``transform`` adds if_score (higher = more anomalous), prob and pred."""

    pre: Preprocessor
    forest: IsolationForestModel
    augment_scaled: bool
    aug_scaler: StandardScale
    booster: TreeEnsemble

    @classmethod
    def fit(
        cls, df: DataFrame, features: Sequence[str] = tuple(CORE_FEATURES), label: str = "y", key: str = "flow_id",
        forest_trees: int = 100, trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42, augment_scaled: bool = True,
    ) -> HybridDetector:
        train = materialise(df.select(*[col(f) for f in dict.fromkeys([*features, label, key])]), "train")
        pre = Preprocessor.fit(train, features)
        forest = IsolationForest(forest_trees, seed=seed).fit(pre.transform(train), pre.names, key)
        # a shell without its booster gives the training rows exactly the serving treatment
        shell = cls(pre, forest, augment_scaled, StandardScale(), None)
        augmented = materialise(shell._augmented(train).select(*pre.names, SCORE_FEATURE, label), "augmented")
        aug_scaler = StandardScale.fit(augmented, [*pre.names, SCORE_FEATURE])
        booster = fit_boosted_trees(aug_scaler.transform(augmented), [*pre.names, SCORE_FEATURE], label, trees, depth, rate)
        return cls(pre, forest, augment_scaled, aug_scaler, booster)

    def _augmented(self, df: DataFrame) -> DataFrame:
        scored = self.forest.score(self.pre.transform(df), SCORE_FEATURE, negate=True)
        if self.augment_scaled:
            return scored
        # put the unscaled values back: x = z·σ + μ
        back = {n: F.col(n) * F.lit(s) + F.lit(m) for n, (m, s) in self.pre.scaler.stats.items()}
        return scored.withColumns(back)

    def inputs(self, df: DataFrame) -> DataFrame:
        """Rows with the booster's scaled inputs (x0…, if_anomaly_score) and if_score."""
        return self.aug_scaler.transform(self._augmented(df).withColumn("if_score", F.col(SCORE_FEATURE)))

    def transform(self, df: DataFrame, keep_inputs: bool = False) -> DataFrame:
        out = self.booster.predict(self.inputs(df))
        return out if keep_inputs else out.drop(*self.pre.names, SCORE_FEATURE)

    @property
    def input_names(self) -> list[str]:
        return [*self.pre.names, SCORE_FEATURE]

    @property
    def feature_names(self) -> list[str]:
        return [*self.pre.features, SCORE_FEATURE]

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {
            "features": self.pre.features, "medians": self.pre.imputer.medians, "skewed": self.pre.log.skewed,
            "scale": self.pre.scaler.stats, "aug_scale": self.aug_scaler.stats, "augment_scaled": self.augment_scaled,
            "psi": self.forest.psi, "limit": self.forest.limit, "forest_cols": self.forest.cols,
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        self.forest.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
        self.booster.model.save(spark, f"{path}/booster")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HybridDetector:
        m = json.loads(spark.read.text(f"{path}/meta").first()[0])
        stats = lambda d: StandardScale({k: tuple(v) for k, v in d.items()})
        pre = Preprocessor(m["features"], MedianImputer(m["medians"]), SkewLog1p(m["skewed"]), stats(m["scale"]))
        nodes = spark.read.parquet(f"{path}/forest").toArrow().to_pandas().sort_values(["tree_id", "node_id"], ignore_index=True)
        forest = IsolationForestModel(m["forest_cols"], nodes, m["psi"], m["limit"])
        booster = TreeEnsemble(NodeTrees.load(spark, f"{path}/booster"), [*pre.names, SCORE_FEATURE])
        return cls(pre, forest, m["augment_scaled"], stats(m["aug_scale"]), booster)
