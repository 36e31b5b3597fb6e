"""Isolation forest (Liu, Ting & Zhou 2008): trees grown in parallel tasks, rows scored in vectorised batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.functions.scalars import col
from flowarden.models.histogram import Scorer
from flowarden.operators.sampling import first_by_hash, hash_order
from flowarden.session import spread

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, left int, right int, n int, depth int"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    full = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """(node, feature, threshold, left, right, n, depth) rows; node i has children 2i+1 and 2i+2."""
    nodes, todo = [], [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(splittable):
            nodes.append((node, -1, float("nan"), -1, -1, len(rows), depth))
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(lo[f], hi[f]))
        if cut >= hi[f]:  # neighbouring floats: keep both sides non-empty
            cut = float(lo[f])
        left = part[:, f] <= cut
        nodes.append((node, f, cut, 2 * node + 1, 2 * node + 2, len(rows), depth))
        todo += [(2 * node + 2, depth + 1, rows[~left]), (2 * node + 1, depth + 1, rows[left])]
    return nodes


@dataclass
class IsolationForest:
    """``fit`` reads one bounded sample: trees × psi rows, chosen by ``md5(key‖seed)``; every tree draws psi of them."""

    trees: int = 100
    psi: int = 256
    seed: int = 42

    def fit(self, df: DataFrame, cols: Sequence[str], key: str) -> IsolationForestModel:
        spark = df.sparkSession
        want = self.trees * self.psi
        narrow = df.select(col(key), hash_order(key, self.seed).alias("__h"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        chosen = first_by_hash(narrow, want, "__h", key).select(*[f"x{i}" for i in range(len(cols))])
        x = np.nan_to_num(chosen.toArrow().to_pandas().to_numpy(dtype=float))
        if not len(x):
            raise ValueError("no rows to fit")
        seed = self.seed
        psi = min(self.psi, len(x))
        limit = max(1, math.ceil(math.log2(psi))) if psi > 1 else 1
        shared = spark.sparkContext.broadcast(x)

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = shared.value
            for pdf in batches:
                for t in pdf["id"]:
                    rng = np.random.default_rng([seed, int(t)])
                    own = rows[rng.permutation(len(rows))[:psi]]
                    table = pd.DataFrame(
                        grow_tree(own, limit, rng), columns=["node_id", "feature", "threshold", "left", "right", "n", "depth"]
                    )
                    table.insert(0, "tree_id", int(t))
                    yield table

        tasks = min(self.trees, spark.sparkContext.defaultParallelism)
        nodes = spark.range(0, self.trees, 1, tasks).mapInPandas(grow, NODE_SCHEMA).toArrow().to_pandas()
        shared.unpersist()
        nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
        return IsolationForestModel(list(cols), nodes, psi, limit)


@dataclass
class IsolationForestModel:
    """Fitted trees as a node table of bounded size (at most trees × 2·psi rows)."""

    cols: list[str]
    nodes: pd.DataFrame
    psi: int
    limit: int

    def arrays(self, adjust: bool) -> tuple[np.ndarray, ...]:
        """Roots, then feature (-1: leaf), threshold, left, right of all nodes, and the path length of a leaf."""
        n = self.nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
        tree, ident = n["tree_id"].to_numpy(), n["node_id"].to_numpy()
        place = {key: i for i, key in enumerate(zip(tree.tolist(), ident.tolist()))}
        left, right = (np.array([place.get(key, 0) for key in zip(tree.tolist(), n[side].tolist())], np.int64) for side in ("left", "right"))
        value = n["depth"].to_numpy().astype(float)
        if adjust:
            value = value + average_path(n["n"].to_numpy())
        roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        return roots, n["feature"].to_numpy(), n["threshold"].to_numpy(), left, right, value

    def _path_udf(self, spark: SparkSession, adjust: bool):
        shared = spark.sparkContext.broadcast(Scorer(self.arrays(adjust)))

        @F.pandas_udf("double")
        def mean_path(*features: pd.Series) -> pd.Series:
            x = np.nan_to_num(np.column_stack([f.to_numpy(dtype=float) for f in features]))
            return pd.Series(shared.value.total(x) / shared.value.trees)

        return mean_path(*[col(c).cast("double") for c in self.cols])

    def score(self, df: DataFrame, name: str = "if_score", negate: bool = False) -> DataFrame:
        """−2^(−E[h]/c(psi)): lower is more anomalous; ``negate`` gives the positive form."""
        scale = float(average_path(self.psi)) or 1.0
        df = spread(df)
        s = F.pow(F.lit(2.0), -self._path_udf(df.sparkSession, True) / F.lit(scale))
        return df.withColumn(name, s if negate else -s)

    def mean_path_length(self, df: DataFrame, name: str = "mean_path") -> DataFrame:
        """Average number of splits on the way to a row's leaf."""
        return spread(df).withColumn(name, self._path_udf(df.sparkSession, False))

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.Table.from_pandas(self.nodes, preserve_index=False), NODE_SCHEMA)

    def split_counts(self, spark: SparkSession) -> DataFrame:
        """Splits per tree and feature."""
        names = F.create_map(*[x for i, c in enumerate(self.cols) for x in (F.lit(i), F.lit(c))])
        inner = self.node_table(spark).where(F.col("feature") >= 0)
        return inner.groupBy("tree_id", names[F.col("feature")].alias("feature")).agg(F.count(F.lit(1)).alias("splits"))

    def trace_paths(self, df: DataFrame, key: str, tree: int = 0) -> DataFrame:
        """One row per row and split on its way through one tree."""
        own = self.nodes[self.nodes["tree_id"] == tree]
        place = np.full(int(own["node_id"].max()) + 1, -1)
        place[own["node_id"]] = np.arange(len(own))
        feature, threshold = own["feature"].to_numpy(), own["threshold"].to_numpy()
        cols, key_type = self.cols, df.schema[key].dataType.simpleString()
        names = np.array(cols, object)

        def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.nan_to_num(pdf[[f"x{i}" for i in range(len(cols))]].to_numpy(dtype=float))
                at = np.zeros(len(x), np.int64)
                alive, step = np.arange(len(x)), 0
                while True:
                    node = place.take(at[alive])
                    f = feature.take(node)
                    inner = f >= 0
                    alive, node, f = alive[inner], node[inner], f[inner]
                    if not len(alive):
                        break
                    step += 1
                    cut = threshold.take(node)
                    value = x[alive, f]
                    right = value > cut
                    yield pd.DataFrame(
                        {
                            "key": pdf["key"].to_numpy()[alive], "step": step, "node": at[alive], "feature": names.take(f),
                            "threshold": cut, "value": value, "direction": np.where(right, "RIGHT", "LEFT"),
                        }
                    )
                    at[alive] = 2 * at[alive] + 1 + right

        rows = spread(df).select(col(key).alias("key"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        schema = f"key {key_type}, step int, node int, feature string, threshold double, value double, direction string"
        return rows.mapInPandas(trace, schema).withColumnRenamed("key", key)
