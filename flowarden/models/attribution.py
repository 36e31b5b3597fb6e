"""Additive per-feature contributions of boosted trees, in log-odds (path-dependent tree Shapley values).

A leaf contributes through the features on its path only. Whether a row satisfies each of them is one bit,
so the Shapley terms of a leaf are tabulated once per bit pattern; a row then needs comparisons and look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.functions.scalars import IMPACT_TYPE, display_name, rank_attribution
from flowarden.models.histogram import NodeTrees
from flowarden.session import spread


def _leaf_paths(tree: pd.DataFrame) -> list[tuple[float, list[int], list[float], list[float], list[float]]]:
    """Per leaf: value, features, lower and upper bounds, and the share of cover kept when a feature is unknown."""
    by_id = {r.id: r for r in tree.itertuples()}
    leaves, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        node = by_id[at]
        if node.left < 0:
            fs = sorted(path)
            leaves.append((node.value, fs, [path[f][0] for f in fs], [path[f][1] for f in fs], [path[f][2] for f in fs]))
            continue
        for child, is_left in ((node.left, True), (node.right, False)):
            lo, hi, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
            kept = share * by_id[child].cover / node.cover
            bounds = (lo, min(hi, node.threshold), kept) if is_left else (max(lo, node.threshold), hi, kept)
            todo.append((child, {**path, node.feature: bounds}))
    return leaves


def _pattern_terms(value: float, shares: Sequence[float]) -> np.ndarray:
    """[2^d, d] contributions of one leaf for every pattern of satisfied features."""
    d = len(shares)
    z = np.array(shares)
    on = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    weights = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    out = np.empty((2**d, d))
    for j in range(d):
        poly = np.zeros((2**d, d))
        poly[:, 0] = 1.0
        for k in range(d):
            if k != j:
                poly[:, 1:] = poly[:, 1:] * z[k] + poly[:, :-1] * on[:, [k]]
                poly[:, 0] *= z[k]
        out[:, j] = value * (on[:, j] - z[j]) * (poly @ weights)
    return out


def shapley_tables(nodes: pd.DataFrame, weights: Sequence[float]) -> tuple[list[tuple], float]:
    """Per tree the padded leaf arrays, and the base value; both in log-odds (twice the margin)."""
    trees, base = [], 0.0
    for t, tree in nodes.groupby("treeID"):
        w = 2.0 * weights[int(t)]
        leaves = _leaf_paths(tree)
        base += w * sum(v * float(np.prod(z)) for v, _, _, _, z in leaves)
        leaves = [leaf for leaf in leaves if leaf[1]]
        if not leaves:
            continue
        d = max(len(leaf[1]) for leaf in leaves)
        feature = np.zeros((len(leaves), d), np.int64)
        lo, hi = np.full((len(leaves), d), np.inf), np.full((len(leaves), d), -np.inf)
        start = np.zeros(len(leaves), np.int64)
        terms, at = [], 0
        for i, (v, fs, los, his, shares) in enumerate(leaves):
            k = len(fs)
            feature[i, :k], lo[i, :k], hi[i, :k] = fs, los, his
            table = np.zeros((2**k, d))
            table[:, :k] = _pattern_terms(w * v, shares)
            start[i] = at
            terms.append(table)
            at += 2**k
        trees.append((feature, lo, hi, start, np.concatenate(terms)))
    return trees, base


def shapley_values(x: np.ndarray, trees: list[tuple], n_features: int) -> np.ndarray:
    out = np.zeros((len(x), n_features))
    for feature, lo, hi, start, terms in trees:
        v = x[:, feature]
        bits = ((v > lo) & (v <= hi)) @ (1 << np.arange(feature.shape[1]))
        contrib = terms[start + bits]
        owner = np.zeros((feature.size, n_features))
        owner[np.arange(feature.size), feature.ravel()] = 1.0
        out += contrib.reshape(len(x), -1) @ owner
    return out


class Attributor:
    """``transform`` adds ``contributions`` (strongest first) for rows carrying the booster's inputs."""

    def __init__(self, spark: SparkSession, model: NodeTrees, inputs: Sequence[str], features: Sequence[str]):
        # leaves are in log-odds already, that is twice a margin of one half
        self.trees, self.base = shapley_tables(model.nodes, [0.5] * model.trees)
        self.inputs, self.features = list(inputs), list(features)

    def values(self, df: DataFrame, name: str = "__phi", only: Column | None = None) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        k = len(self.inputs)

        @F.pandas_udf("array<double>")
        def phi(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for wanted, *columns in batches:
                rows = np.flatnonzero(wanted.to_numpy(dtype=bool))
                x = np.column_stack([c.to_numpy(dtype=float).take(rows) for c in columns])
                out = np.full(len(wanted), None, object)
                for i in range(0, len(x), 2000):
                    for at, row in zip(rows[i : i + 2000], shapley_values(x[i : i + 2000], shared.value, k)):
                        out[at] = row
                yield pd.Series(out)

        wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
        return spread(df).withColumn(name, phi(wanted, *self.inputs))

    def transform(self, df: DataFrame, name: str = "contributions", only: Column | None = None) -> DataFrame:
        """With ``only`` the other rows get an empty list, and no value is worked out for them."""
        out = self.values(df, only=only)
        items = F.array(
            *[
                F.struct(F.lit(f).alias("feature"), display_name(F.lit(f)).alias("display_name"), F.col("__phi")[i].alias("impact"))
                for i, f in enumerate(self.features)
            ]
        )
        ranked = rank_attribution(items.cast(IMPACT_TYPE))
        if only is not None:
            ranked = F.when(F.coalesce(only, F.lit(False)), ranked).otherwise(F.array().cast(IMPACT_TYPE))
        return out.withColumn(name, ranked).drop("__phi")
