"""Tree ensembles over binned features: second-order boosting, SAMME stumps and random forests, with node tables as models.

* ``bin_table`` cuts every feature once into at most 256 bins and stores one byte per feature and row, in blocks of rows.
* Boosting needs, per level of a tree, two sums for every (node, feature, bin). Two places can give them: ``TableSums``
  keeps the blocks and their scores in the executors and asks for one sum over them per level, ``TaskSums`` holds a counted
  table of at most ``task_rows`` rows inside one task, where a level is a few array operations instead of a job. Sums are
  whole numbers (fixed point), so they do not depend on partitions or order, and both places grow the same trees; of two
  children only the lighter is summed, the other is what is left of their parent.
* Random-forest trees are independent: they grow in parallel tasks, each with a copy of the different binned rows in a file,
  on draws from all rows and without a depth limit. At most ``held_rows`` binned rows are in a task's memory.
* A fitted model is a table of nodes (a few thousand rows); rows are scored in batches that walk all trees at once.
"""

from __future__ import annotations

import json
import math
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.functions.scalars import col
from flowarden.session import materialise, shared_dir, spread

BINS = 256
FEW_VALUES = 200  # a feature of about so many different values gets a cut at every one
TASK_ROWS = 1_000_000
HELD_ROWS = 500_000  # that a task growing a tree takes into memory
STORED_TREES = 20  # of a distributed fit between two stored scores
BLOCK_ROWS = 32_768  # of a block, at least, but for the last of a part
MOST_GATHERED = 32  # parts whose sums the driver adds up itself
UNIT = 2.0**32  # of the fixed-point sums
NODES = "treeID int, id int, feature int, threshold double, left int, right int, value double, cover double"
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
LOGISTIC, MEAN = "logistic", "mean"


# ---- bins ----------------------------------------------------------------------------------------------
def fit_cuts(df: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """Ascending cuts per feature, all of them values of the table; a row lies left of a cut if its value is at most that.

    One pass gives quantiles, a second all values of the features that have few. Nulls, NaN and infinities make no cut.
    """
    plain = [F.when(F.abs(x) < math.inf, x).alias(f"x{i}") for i, x in enumerate(col(c).cast("double") for c in cols)]
    x = df.select(*plain)
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    row = x.agg(*[F.struct(F.approx_count_distinct(n, 0.02).alias("n"), F.percentile_approx(n, shares, 10_000).alias("q"), F.max(n).alias("top")).alias(n) for n in x.columns]).first()
    few = [n for n in x.columns if row[n]["n"] <= FEW_VALUES]
    values = x.agg(*[F.collect_set(n).alias(n) for n in few]).first() if few else {}
    cuts = []
    for n in x.columns:
        own = np.unique(np.array((values[n] if n in few else row[n]["q"]) or [], float))
        own = own[own < row[n]["top"]] if len(own) else own
        if len(own) >= BINS:  # more values than the estimate said
            own = own[np.linspace(0, len(own) - 1, BINS - 1).round().astype(int)]
        cuts.append(own)
    return cuts


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """[rows, features] bytes: the number of cuts below a value; a missing value lies below all."""
    x = np.where(np.isnan(x), -np.inf, x)
    return np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)


def bin_table(df: DataFrame, cols: Sequence[str], label: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """Stored ``(bins binary, y binary)``, a row for every block of table rows: one byte per feature and row, feature by feature."""
    d = len(cols)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, y = _binned(batch, d, cuts)
                yield pa.RecordBatch.from_pydict({"bins": pa.array([bins.T.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})

    return materialise(spread(_features(df, cols, label)).mapInArrow(convert, "bins binary, y binary"), "binned")


def _features(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    return df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.coalesce(F.col(label).cast("byte"), F.lit(0).cast("byte")).alias("y"))


def _binned(batch: pa.RecordBatch, d: int, cuts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(d)])
    return to_bins(x, cuts), batch.column(d).to_numpy(zero_copy_only=False).astype(np.int8)


Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins [features, rows], class and score of each row


def _blocks(stored: Iterator[tuple[bytes, bytes]], d: int) -> Iterator[Block]:
    """Stored blocks put together to at least ``BLOCK_ROWS`` rows, with scores of zero."""
    held, rows = [], 0

    def joined() -> Block:
        bins, y = zip(*held)
        return np.concatenate(bins, axis=1), np.concatenate(y), np.zeros(rows)

    for bins, y in stored:
        held.append((np.frombuffer(bins, np.uint8).reshape(d, -1), np.frombuffer(y, np.int8)))
        rows += len(y)
        if rows >= BLOCK_ROWS:
            yield joined()
            held, rows = [], 0
    if held:
        yield joined()


def _cells(blocks: Iterable[Block], tree: HeapTree, slots: np.ndarray, n: int, d: int, loss) -> np.ndarray:
    """[n, features, BINS, 2] sums of the two statistics over the rows at the tree's positions that have a slot."""
    total = np.zeros((2, d, n * BINS), np.int64)
    known = slots[2**tree.levels - 1 : 2 ** (tree.levels + 1) - 1]
    for bins, y, score in blocks:
        slot = known.take(tree.place(bins))
        held = np.flatnonzero(slot >= 0)
        some = len(held) < len(slot)
        if some:
            y, score, slot = y.take(held), score.take(held), slot.take(held)
        parts = []
        for k, own in enumerate(loss.stats(score, y)):
            own = np.rint(own * UNIT)
            # bincount adds floats: whole numbers stay exact below 2^53, larger totals are added in two halves
            if np.abs(own).sum() < 2.0**52:
                parts.append((k, own, 1))
            else:
                high = np.floor(own / 2.0**20)
                parts += [(k, high, 1 << 20), (k, own - high * 2.0**20, 1)]
        first = slot * BINS
        for f in range(d):
            key = first + (bins[f].take(held) if some else bins[f])
            for k, part, unit in parts:
                total[k, f] += np.bincount(key, part, n * BINS).astype(np.int64) * unit
    return total.reshape(2, d, n, BINS).transpose(2, 1, 3, 0)


# ---- a tree as arrays in heap order --------------------------------------------------------------------
@dataclass
class HeapTree:
    """Split feature and bin of inner positions (feature -1: not split), and per position what a row of each class gets."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    levels: int = 0  # that are split so far

    @classmethod
    def empty(cls, depth: int) -> HeapTree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros((size, 2)))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Places, from the left, that rows given as [features, rows] come to in the first level that is not split.

        Whole columns are compared, one for every split. A row at a leaf further up goes to the first place below it.
        """
        n = bins.shape[1]
        place = np.zeros(n, np.uint8 if self.levels <= 8 else np.int64)
        feature, cut = self.feature.tolist(), self.cut.tolist()
        held = {0: None}  # which rows are at a split position
        for _ in range(self.levels):
            below, bit = {}, np.zeros(n, bool)
            for at, rows in held.items():
                right = bins[feature[at]] > cut[at]
                if rows is not None:
                    right &= rows
                bit |= right
                if feature[2 * at + 1] >= 0:
                    below[2 * at + 1] = ~right if rows is None else rows ^ right
                if feature[2 * at + 2] >= 0:
                    below[2 * at + 2] = right
            place += place
            place += bit
            held = below
        return place

    def gain(self, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What the rows get."""
        value, feature = self.value.copy(), self.feature
        for at in range(2**self.levels - 1):
            if feature[at] < 0:
                value[2 * at + 1] = value[at]
        return value[2**self.levels - 1 :].ravel().take(2 * self.place(bins).astype(np.int64) + y)


class Logistic:
    """Gradient and hessian of the log loss at a score."""

    @staticmethod
    def stats(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-score))
        return p - y, np.maximum(p * (1.0 - p), 1e-16)


class ClassWeights:
    """Row weights exp(score), counted for the class of the row."""

    @staticmethod
    def stats(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.exp(score)
        return np.where(y == 0, w, 0.0), np.where(y == 1, w, 0.0)


class TaskSums:
    """The sums over a table held in this task."""

    def __init__(self, blocks: list[Block], d: int, loss):
        self.blocks, self.d, self.loss = blocks, d, loss

    def level(self, tree: HeapTree, slots: np.ndarray, n: int) -> np.ndarray:
        return _cells(self.blocks, tree, slots, n, self.d, self.loss)

    def end(self, tree: HeapTree, shift: float = 0.0) -> None:
        self.blocks = [(bins, y, score + (tree.gain(bins, y) + shift)) for bins, y, score in self.blocks]


class TableSums:
    """The sums over a stored table: its blocks stay in the executors with their scores, which are stored every ``STORED_TREES`` trees.

    Scores of a lost executor are made again from the last stored ones.
    """

    def __init__(self, table: DataFrame, d: int, loss):
        self.d, self.loss, self.trees = d, loss, 0
        cores = table.sparkSession.sparkContext.defaultParallelism
        parts = table.rdd.getNumPartitions()
        self.spark = table.sparkSession
        shared_dir(self.spark)  # where scores are stored
        even = table.repartition(cores) if parts < cores else table.coalesce(cores)
        self.rows = even.rdd.mapPartitions(lambda rows: _blocks(rows, d)).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: list[RDD] = []
        self.stored: list[RDD] = []

    def level(self, tree: HeapTree, slots: np.ndarray, n: int) -> np.ndarray:
        d, loss = self.d, self.loss  # a task gets no part of this object
        found = self.rows.mapPartitions(lambda blocks: [_cells(blocks, tree, slots, n, d, loss)])
        if found.getNumPartitions() > MOST_GATHERED:
            total = found.treeReduce(np.add)
        else:
            total = np.add.reduce(found.collect())  # bounded by nodes of a level x features x bins, for each part
        self._drop()
        return total

    def end(self, tree: HeapTree, shift: float = 0.0) -> None:
        self._drop()
        self.before = [self.rows]
        self.rows = self.rows.map(lambda b: (b[0], b[1], b[2] + (tree.gain(b[0], b[1]) + shift))).persist(StorageLevel.MEMORY_AND_DISK)
        self.trees += 1
        if self.trees % STORED_TREES == 0:
            self.rows.checkpoint()
            self.stored.append(self.rows)

    def _drop(self) -> None:
        """Scores that newer ones have taken the place of."""
        for rows in self.before:
            rows.unpersist()
        self.before = []
        while len(self.stored) > 1 and self.stored[1].isCheckpointed():
            self._delete(self.stored.pop(0))

    def _delete(self, rows: RDD) -> None:
        if path := rows.getCheckpointFile():
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def close(self) -> None:
        self._drop()
        self.rows.unpersist()
        for rows in self.stored:
            self._delete(rows)


# ---- growing -------------------------------------------------------------------------------------------
def boost(sums, cuts: Sequence[np.ndarray], trees: int, depth: int, rate: float, ridge: float, least_hessian: float) -> list[tuple]:
    """Rows of the node table. Equal gains go to the first feature and the lowest cut."""
    usable = np.arange(BINS)[None, :] < np.array([len(c) for c in cuts])[:, None]
    nodes = []
    for t in range(trees):
        tree = HeapTree.empty(depth)
        cover = np.zeros(len(tree.feature))
        active = summed = np.array([0])
        for level in range(depth):
            slots = np.full(len(tree.feature), -1)
            slots[summed] = np.arange(len(summed))
            cells = sums.level(tree, slots, len(summed))
            if level:  # whole numbers: the heavier child has exactly what the lighter leaves of its parent
                pairs = np.empty((len(summed), 2, *cells.shape[1:]), np.int64)
                place = np.arange(len(summed))
                pairs[place, heavier], pairs[place, 1 - heavier] = parents - cells, cells
                cells = pairs.reshape(-1, *cells.shape[1:])
            left = cells.cumsum(axis=2) / UNIT
            whole = left[:, 0, -1]
            if not level:
                cover[0], tree.value[0] = whole[0, 1], -rate * whole[0, 0] / (whole[0, 1] + ridge)
            g, h = left[..., 0], left[..., 1]
            rest_g, rest_h = whole[:, 0, None, None] - g, whole[:, 1, None, None] - h
            gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - (whole[:, 0] ** 2 / (whole[:, 1] + ridge))[:, None, None]
            gain[~usable[None] | (h < least_hessian) | (rest_h < least_hessian)] = -np.inf
            flat = gain.reshape(len(active), -1)
            best = flat.argmax(axis=1)
            split = flat[np.arange(len(active)), best] > 1e-6
            f, b = best[split] // BINS, best[split] % BINS
            at = active[split]
            tree.feature[at], tree.cut[at] = f, b
            # a split's two sums are those of its children, so the last level needs no pass of its own
            below = left[np.flatnonzero(split), f, b]
            for child, own in ((2 * at + 1, below), (2 * at + 2, whole[split] - below)):
                cover[child] = own[:, 1]
                tree.value[child] = (-rate * own[:, 0] / (own[:, 1] + ridge))[:, None]
            tree.levels = level + 1
            active = np.column_stack([2 * at + 1, 2 * at + 2]).ravel()
            if not len(active):
                break
            heavier = (below[:, 1] <= (whole[split] - below)[:, 1]).astype(int)
            summed, parents = 2 * at + 2 - heavier, cells[split]
        inner = tree.feature >= 0
        tree.value[inner] = 0.0
        sums.end(tree)
        todo = [0]
        while todo:
            i = todo.pop()
            f = int(tree.feature[i])
            if f >= 0:
                nodes.append((t, i, f, float(cuts[f][tree.cut[i]]), 2 * i + 1, 2 * i + 2, 0.0, float(cover[i])))
                todo += [2 * i + 2, 2 * i + 1]
            else:
                nodes.append((t, i, -1, math.nan, -1, -1, float(tree.value[i, 0]), float(cover[i])))
    return nodes


def stumps(sums, cuts: Sequence[np.ndarray], rounds: int, rate: float) -> list[tuple]:
    """SAMME (Zhu et al. 2009): (feature, threshold, class at or below, class above, weight) of each round's best Gini split."""
    usable = np.arange(BINS)[None, :] < np.array([len(c) for c in cuts])[:, None]
    found: list[tuple] = []
    slots = np.array([0, -1, -1])
    for _ in range(rounds):
        tree = HeapTree.empty(1)
        left = sums.level(tree, slots, 1)[0].cumsum(axis=1) / UNIT
        whole = left[0, -1]
        right = whole - left
        score = (left**2).sum(-1) / np.maximum(left.sum(-1), 1e-300) + (right**2).sum(-1) / np.maximum(right.sum(-1), 1e-300)
        score[~usable | (left.sum(-1) <= 0) | (right.sum(-1) <= 0)] = -np.inf
        best = int(score.argmax())
        f, b = divmod(best, BINS)
        if score.flat[best] == -math.inf or score.flat[best] <= (whole**2).sum() / whole.sum() * (1 + 1e-12):
            if not found:
                own = float(whole[1] > whole[0])
                found.append((0, math.inf, own, own, 1.0))
            break
        below, above = float(left[f, b, 1] > left[f, b, 0]), float(right[f, b, 1] > right[f, b, 0])
        wrong = left[f, b, 1 - int(below)] + right[f, b, 1 - int(above)]
        err = wrong / whole.sum()
        threshold = float(cuts[f][b])
        if err <= 1e-12:
            return [(f, threshold, below, above, 1.0)]
        if err >= 0.5:
            break
        alpha = rate * math.log((1 - err) / err)
        found.append((f, threshold, below, above, alpha))
        tree.feature[0], tree.cut[0] = f, b
        tree.value[1], tree.value[2] = [alpha * (y != below) for y in (0, 1)], [alpha * (y != above) for y in (0, 1)]
        tree.levels = 1
        sums.end(tree, -math.log(1 - err + err * math.exp(alpha)))  # weights keep their total
    return found


def _counted(table: DataFrame) -> int:
    rows = table.agg(F.sum(F.length("y"))).first()[0]
    if not rows:
        raise ValueError("no rows to fit")
    return rows


def _in_task(table: DataFrame, d: int, grow, schema: str) -> pd.DataFrame:
    """Run ``grow(blocks)`` over a counted, bounded table inside one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(_blocks((row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), d))
        if blocks:
            fields = pa.schema([(n, ARROW[t]) for n, t in (c.split() for c in schema.split(", "))])
            yield pa.RecordBatch.from_pandas(pd.DataFrame(grow(blocks), columns=fields.names), fields, preserve_index=False)

    return table.coalesce(1).mapInArrow(run, schema).toArrow().to_pandas()


def _over_table(table: DataFrame, d: int, loss, grow) -> list[tuple]:
    """What ``grow(sums)`` makes of the sums over a table of any size."""
    with closing(TableSums(table, d, loss)) as sums:
        return grow(sums)


STUMP = "feature long, threshold double, below double, above double, weight double"


def fit_stumps(df: DataFrame, cols: Sequence[str], label: str, rounds: int, rate: float, task_rows: int = TASK_ROWS) -> list[tuple]:
    cuts = fit_cuts(df, cols)
    table, d = bin_table(df, cols, label, cuts), len(cols)

    def grow(sums) -> list[tuple]:
        return stumps(sums, cuts, rounds, rate)

    if _counted(table) > task_rows:
        return _over_table(table, d, ClassWeights, grow)
    made = _in_task(table, d, lambda blocks: grow(TaskSums(blocks, d, ClassWeights)), STUMP)
    return [(int(r.feature), r.threshold, r.below, r.above, r.weight) for r in made.itertuples()]


def fit_boosted(
    df: DataFrame, cols: Sequence[str], label: str, trees: int = 100, depth: int = 6, rate: float = 0.1, ridge: float = 1.0,
    least_hessian: float = 1.0, task_rows: int = TASK_ROWS,
) -> NodeTrees:
    """Second-order boosting of the log loss with ridge-regularised leaves, from a score of zero.

    Up to ``task_rows`` rows are boosted inside one task, more by one sum over the executors per level; the trees are the same.
    """
    cuts = fit_cuts(df, cols)
    table, d = bin_table(df, cols, label, cuts), len(cols)

    def grow(sums) -> list[tuple]:
        return boost(sums, cuts, trees, depth, rate, ridge, least_hessian)

    if _counted(table) > task_rows:
        nodes = pd.DataFrame(_over_table(table, d, Logistic, grow), columns=_names(NODES))
    else:
        nodes = _in_task(table, d, lambda blocks: grow(TaskSums(blocks, d, Logistic)), NODES)
    return NodeTrees(nodes, LOGISTIC)


# ---- random forest -------------------------------------------------------------------------------------
def _distinct_rows(df: DataFrame, cols: Sequence[str], label: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """Stored blocks ``(part, block, bins, y, n)`` of the different binned rows, in their order, with the number of table rows of each."""
    d = len(cols)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y = _binned(batch, d, cuts)
            data = bins.tobytes()
            yield pa.RecordBatch.from_pydict({"bins": pa.array([data[i : i + d] for i in range(0, len(data), d)], pa.binary()), "y": pa.array(y)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(b for b in batches if b.num_rows):
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d)
            y, n = batch.column("y").to_numpy().astype(np.int8), batch.column("n").to_numpy().astype(np.int64)
            blobs = {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("bins", bins.T), ("y", y), ("n", n))}
            yield pa.RecordBatch.from_pydict({"part": batch.column("part").slice(0, 1), "block": pa.array([i]), **blobs})

    rows = spread(_features(df, cols, label)).mapInArrow(convert, "bins binary, y byte")
    distinct = rows.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("bins", "y")
    return materialise(distinct.select(F.spark_partition_id().alias("part"), "*").mapInArrow(pack, "part int, block long, bins binary, y binary, n binary"), "distinct")


class ForestRows:
    """The different rows of a table inside a task: bins in a file, class and number of table rows (9 bytes a row) in memory."""

    def __init__(self, batches: Iterator[pa.RecordBatch], d: int, starts: dict[tuple[int, int], int], rows: int):
        self.d, self.rows, self.starts = d, rows, sorted(starts.values())
        self.y, self.count = np.empty(rows, np.int8), np.empty(rows, np.int64)
        self.file = tempfile.TemporaryFile()
        self.file.truncate(rows * d)
        for batch in batches:
            for part, block, bins, y, n in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "bins", "y", "n"))):
                low = starts[part, block]
                self.y[low : low + len(y)], self.count[low : low + len(y)] = np.frombuffer(y, np.int8), np.frombuffer(n, np.int64)
                self.file.seek(low * d)
                self.file.write(bins)
        self.file.flush()

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """The place and the bins [features, rows] of one block after the other."""
        self.file.seek(0)
        for low, end in zip(self.starts, [*self.starts[1:], self.rows]):
            yield slice(low, end), np.frombuffer(self.file.read((end - low) * self.d), np.uint8).reshape(self.d, -1)

    def drawn(self, rng: np.random.Generator) -> np.ndarray:
        """How often a bootstrap draw of as many rows as the table has takes each row; blocks of a fixed size, so their storage does not matter."""
        out = np.zeros(self.rows, np.int32)
        draws = rest = int(self.count.sum())
        for low in range(0, self.rows, BLOCK_ROWS):
            upto = self.count[low : low + BLOCK_ROWS].cumsum()
            own = int(upto[-1])
            n = int(rng.binomial(draws, own / rest)) if rest > own else draws
            out[low : low + len(upto)] = np.bincount(np.searchsorted(upto, rng.integers(0, own, n), side="right"), minlength=len(upto))
            draws, rest = draws - n, rest - own
        return out


def _gini_split(n: np.ndarray, k: np.ndarray) -> tuple[float, int] | None:
    """(score, bin) of the best cut of a feature, from the weight and the weight of class 1 by bin; None if all lie in one bin."""
    n, k = n.cumsum(), k.cumsum()
    total, ones = n[-1], k[-1]
    at = np.flatnonzero((n > 0) & (n < total))
    if not len(at):
        return None
    n, k = n.take(at), k.take(at)
    m, r = total - n, ones - k
    score = (k**2 + (n - k) ** 2) / n + (r**2 + (m - r) ** 2) / m
    best = int(score.argmax())
    return float(score[best]), int(at[best])


def _choose(histogram, d: int, features: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """(feature, bin) of the best split among ``features`` features that offer one, drawn at random; None if none does."""
    chosen, tried = None, 0
    for f in rng.permutation(d).tolist():
        found = _gini_split(*histogram(f))
        if found is None:  # does not count as tried
            continue
        if chosen is None or found[0] > chosen[0] + 1e-12:
            chosen = (found[0], f, found[1])
        tried += 1
        if tried >= features:
            break
    return chosen and chosen[1:]


class ForestTree:
    """One tree, grown on a bootstrap draw by Gini splits until nodes are pure or offer no split.

    Nodes of more than ``held_rows`` different rows are split level by level from histograms over all blocks; the rows of
    smaller ones are taken out of the blocks, at most ``held_rows`` at a time, and split to the end in memory.
    """

    def __init__(self, cuts: Sequence[np.ndarray], features: int, rng: np.random.Generator):
        self.cuts, self.features, self.rng = cuts, features, rng
        self.feature, self.cut, self.left, self.value, self.cover = [-1], [0], [-1], [0.0], [0.0]

    def nodes(self) -> list[tuple]:
        """(id, feature, threshold, left, right, value, cover)"""
        every = zip(self.feature, self.cut, self.left, self.value, self.cover)
        return [(i, f, float(self.cuts[f][c]), at, at + 1, 0.0, w) if f >= 0 else (i, -1, math.nan, -1, -1, v, w) for i, (f, c, at, v, w) in enumerate(every)]

    def _split(self, at: int, total: float, ones: float, histogram) -> bool:
        self.value[at], self.cover[at] = ones / total, total
        chosen = _choose(histogram, len(self.cuts), self.features, self.rng) if 0 < ones < total else None
        if chosen is None:
            return False
        self.feature[at], self.cut[at] = chosen
        self.left[at] = len(self.feature)
        self._add(2)
        return True

    def _add(self, n: int) -> None:
        for known, empty in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.value, 0.0), (self.cover, 0.0)):
            known.extend([empty] * n)

    def _walk(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = left[node] + (bins[feature[node], rows] > cut[node])
        return at

    def grow(self, table: ForestRows, held_rows: int) -> ForestTree:
        weight = table.drawn(self.rng)
        small, large = {}, {}  # open nodes with their different rows
        (small if np.count_nonzero(weight) <= held_rows else large)[0] = np.count_nonzero(weight)
        while large:
            sums = {at: np.zeros((2, table.d, BINS)) for at in large}
            for place, bins, w, at in self._open(table, weight, large):
                for node, own in sums.items():
                    rows = np.flatnonzero(at == node)
                    part = bins.take(rows, axis=1)
                    ws = w.take(rows)
                    ones = ws * table.y[place].take(rows)
                    for f in range(table.d):
                        own[0, f] += np.bincount(part[f], ws, BINS)
                        own[1, f] += np.bincount(part[f], ones, BINS)
            split = [node for node, own in sums.items() if self._split(node, own[0, 0].sum(), own[1, 0].sum(), own.transpose(1, 0, 2).__getitem__)]
            sizes = dict.fromkeys([c for node in split for c in (self.left[node], self.left[node] + 1)], 0)
            for _, _, _, at in self._open(table, weight, sizes) if sizes else ():
                for node, n in zip(*np.unique(at, return_counts=True)):
                    if node in sizes:
                        sizes[node] += int(n)
            large = {node: n for node, n in sizes.items() if n > held_rows}
            small |= {node: n for node, n in sizes.items() if n <= held_rows}
        todo = list(small)
        while todo:
            group, rows = [], 0
            while todo and (not group or rows + small[todo[-1]] <= held_rows):
                group.append(todo.pop())
                rows += small[group[-1]]
            parts = []
            for place, bins, w, at in self._open(table, weight, group):
                held = np.flatnonzero(np.isin(at, group))
                parts.append((bins.take(held, axis=1), w.take(held), table.y[place].take(held), at.take(held)))
            bins, w, y, at = (np.concatenate(p, axis=-1) for p in zip(*parts))
            self._finish(group, bins, w, w * y, at)
        return self

    def _open(self, table: ForestRows, weight: np.ndarray, wanted) -> Iterator[tuple]:
        """Per block its place, and bins, weight and node of the drawn rows."""
        for place, bins in table.blocks():
            w = weight[place].astype(float)
            at = np.where(w > 0, self._walk(bins) if len(self.feature) > 1 else 0, -1)
            yield place, bins, w, at

    def _finish(self, roots: Sequence[int], bins: np.ndarray, weight: np.ndarray, ones: np.ndarray, at: np.ndarray) -> None:
        """Split ``roots`` to the end; ``at`` says which of them a row is in. All nodes of a level are split together."""
        d, n = bins.shape
        flat, rows = np.ascontiguousarray(bins).ravel(), np.arange(n)
        ids = np.array(sorted(roots))
        own = np.searchsorted(ids, at)  # the node of a row, as its place among the open ones
        while len(ids):
            w, k = weight.take(rows), ones.take(rows)
            total, one = np.bincount(own, w, len(ids)), np.bincount(own, k, len(ids))
            for node, t, o in zip(ids.tolist(), total.tolist(), one.tolist()):
                self.value[node], self.cover[node] = o / t, t
            mixed = (one > 0) & (one < total)
            ids, total, one = ids[mixed], total[mixed], one[mixed]
            held = np.flatnonzero(mixed.take(own))
            own, rows, w, k = (mixed.cumsum() - 1).take(own.take(held)), rows.take(held), w.take(held), k.take(held)
            order = self.rng.random((len(ids), d)).argsort(axis=1)
            best, tried = np.full(len(ids), -np.inf), np.zeros(len(ids), int)
            feature, cut = np.full(len(ids), -1), np.zeros(len(ids), int)
            for j in range(d):
                trying = tried < self.features
                if not trying.any():
                    break
                part = slice(None) if trying.all() else np.flatnonzero(trying.take(own))
                f = order[:, j]
                key = own[part] * BINS + flat.take(f.take(own[part]) * n + rows[part])
                node, low, score = _best_cuts(key, w[part], k[part], np.where(trying, total, 0), np.where(trying, one, 0))
                tried[node] += 1
                better = score > best[node] + 1e-12
                node = node[better]
                best[node], feature[node], cut[node] = score[better], f[node], low[better]
            split = feature >= 0
            left = len(self.feature) + 2 * (split.cumsum() - 1)
            for node, f, c, child in zip(ids[split].tolist(), feature[split].tolist(), cut[split].tolist(), left[split].tolist()):
                self.feature[node], self.cut[node], self.left[node] = f, c, child
            grown = 2 * int(split.sum())
            self._add(grown)
            held = np.flatnonzero(split.take(own))
            own, rows = own.take(held), rows.take(held)
            right = flat.take(feature.take(own) * n + rows) > cut.take(own)
            own = 2 * (split.cumsum() - 1).take(own) + right
            ids = np.arange(len(self.feature) - grown, len(self.feature))


def _best_cuts(key: np.ndarray, w: np.ndarray, k: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, ...]:
    """Node, bin and score of the best Gini cut of every node that has one; ``key`` is node x BINS + bin, totals are by node.

    Of equal cuts the lowest is taken. Weights are whole numbers, so their sums are exact.
    """
    order = key.argsort()
    key, n, k = key.take(order), w.take(order).cumsum(), k.take(order).cumsum()
    at = np.flatnonzero(key[1:] != key[:-1])
    at = at[key[at] // BINS == key[at + 1] // BINS]
    if not len(at):
        return at, at, at.astype(float)
    node = key[at] // BINS
    n, k = n[at] - (total.cumsum() - total)[node], k[at] - (ones.cumsum() - ones)[node]
    m, r = total[node] - n, ones[node] - k
    score = (k**2 + (n - k) ** 2) / n + (r**2 + (m - r) ** 2) / m
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, first), np.diff(np.r_[first, len(node)])))
    top = top[np.r_[True, node[top[1:]] != node[top[:-1]]]]
    return node[top], key[at[top]] % BINS, score[top]


def fit_forest(df: DataFrame, cols: Sequence[str], label: str, trees: int = 100, seed: int = 42, held_rows: int = HELD_ROWS) -> NodeTrees:
    """Random forest of fully grown trees, the square root of the features tried at every split.

    Every tree draws from all rows. A task grows its share of the trees from a copy of the table's different binned rows.
    """
    spark = df.sparkSession
    cuts, d = fit_cuts(df, cols), len(cols)
    table = _distinct_rows(df, cols, label, cuts)
    known = table.select("part", "block", F.length("y").alias("rows")).orderBy("part", "block").collect()  # a row for each block
    if not known:
        raise ValueError("no rows to fit")
    ends = np.cumsum([r["rows"] for r in known]).tolist()
    starts = {(r["part"], r["block"]): end - r["rows"] for r, end in zip(known, ends)}
    rows, features = ends[-1], max(1, int(math.sqrt(d)))
    tasks = min(trees, spark.sparkContext.defaultParallelism)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        own = ForestRows(chain([first], batches), d, starts, rows)
        for t in range(first.column("task")[0].as_py(), trees, tasks):
            made = pd.DataFrame(ForestTree(cuts, features, np.random.default_rng([seed, t])).grow(own, held_rows).nodes(), columns=_names(NODES)[1:])
            made.insert(0, "treeID", t)
            fields = pa.schema([(n, ARROW[kind]) for n, kind in (c.split() for c in NODES.split(", "))])
            yield pa.RecordBatch.from_pandas(made, fields, preserve_index=False)

    copies = table.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    return NodeTrees(copies.mapInArrow(grow, NODES).toArrow().to_pandas(), MEAN)


# ---- models --------------------------------------------------------------------------------------------
def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class NodeTrees:
    """Fitted trees as a node table. A row goes left if its value is at most the threshold or missing.

    ``link`` says how leaf values make a probability: the logistic function of their sum, or their mean.
    """

    nodes: pd.DataFrame
    link: str = LOGISTIC

    def __post_init__(self):
        kinds = {n: "float64" if t == "double" else "int64" for n, t in (c.split() for c in NODES.split(", "))}
        self.nodes = self.nodes.astype(kinds).sort_values(["treeID", "id"], ignore_index=True)

    @property
    def trees(self) -> int:
        return self.nodes["treeID"].nunique()

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Roots, then feature (-1: leaf), threshold, left, right and value of all nodes of all trees."""
        n = self.nodes
        tree, ident = n["treeID"].to_numpy(), n["id"].to_numpy()
        place = {key: i for i, key in enumerate(zip(tree.tolist(), ident.tolist()))}
        left, right = (np.array([place.get(key, 0) for key in zip(tree.tolist(), n[side].tolist())], np.int64) for side in ("left", "right"))
        roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        return roots, n["feature"].to_numpy(), n["threshold"].to_numpy(), left, right, n["value"].to_numpy()

    def probability(self, spark: SparkSession, inputs: Sequence):
        """Probability column of the input columns."""
        shared, link = spark.sparkContext.broadcast(Scorer(self.arrays())), self.link

        @F.pandas_udf("double")
        def compute(*features: pd.Series) -> pd.Series:
            x = np.column_stack([f.to_numpy(dtype=float) for f in features])
            total = shared.value.total(x)
            trees = shared.value.trees
            return pd.Series(total / trees if link == MEAN else 1.0 / (1.0 + np.exp(-total)))

        return compute(*inputs)

    def save(self, spark: SparkSession, path: str) -> None:
        table = pa.Table.from_pandas(self.nodes, preserve_index=False)
        spark.createDataFrame(table, NODES).withColumn("link", F.lit(self.link)).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NodeTrees:
        nodes = spark.read.parquet(path).toArrow().to_pandas()
        return cls(nodes.drop(columns="link"), str(nodes["link"].iloc[0]))


WORD = 64  # leaves of a tree that share a machine word
BLOCK_BYTES = 1024 * 1024  # most memory of the leaf bits of a block of trees: what a core's own cache holds
BIT_ROWS, WALK_ROWS = 512, 4096  # scored at a time: bits of so many rows fit a core's cache, a walk has costs per step
WALKERS = 32_768  # rows times trees that are walked together
MOST_WORDS, RANK_BITS, FEATURE_BITS = 4, 20, 16
LOW = (1 << (RANK_BITS + FEATURE_BITS)) - 1


class Scorer:
    """Sums of leaf values over all trees, in their order, for rows given as a float matrix.

    A value is replaced once by its rank among the thresholds of its feature. A tree of few leaves is a row of bits, one
    for each leaf (QuickScorer, Lucchese et al. 2015): the rank of every feature closes the leaves it rules out, and the
    one that stays open is the row's. Of a larger tree the top, grown to a word of exits, is such a row of bits, and the
    rest is walked from the exit, with a node in one number and leaves that lead to themselves. Bits are kept for blocks
    of trees, each with the ranks among its own thresholds alone, so that a block stays in the cache.
    """

    def __init__(self, arrays: tuple[np.ndarray, ...]):
        self.arrays = arrays
        roots, feature, threshold, left, right, value = arrays
        inner = feature >= 0
        self.thresholds = {int(f): np.unique(threshold[inner & (feature == f)]) for f in np.unique(feature[inner])}
        rank = np.zeros(len(feature), np.int64)
        for f, cuts in self.thresholds.items():
            own = inner & (feature == f)
            rank[own] = np.searchsorted(cuts, threshold[own])
        self.trees = len(roots)
        self.walked: set[int] = set()
        shapes, tables, placed = [], [], 0
        for t, root in enumerate(roots.tolist()):
            leaves, splits = self._leaves(root, feature, left, right, None)
            if len(leaves) > MOST_WORDS * WORD:
                leaves, splits = self._leaves(root, feature, left, right, self._top(root, feature, left, right))
                nodes, values, place = self._table(root, feature, rank, left, right, value, placed)
                self.walked.add(t)
                tables.append((nodes, values))
                placed += len(nodes)
                exits = np.array([place[n] for n in leaves], float)  # where the walk goes on
            else:
                exits = value[leaves]
            shapes.append((exits, splits))
        self.nodes, self.ends = (np.concatenate(p) for p in zip(*tables)) if tables else (None, None)
        self.blocks = []
        first, words, rows = 0, 0, 0
        for t, (exits, splits) in enumerate(shapes):
            own = -(-len(exits) // WORD)
            if t > first and (words + own) * (rows + len(splits)) * 8 > BLOCK_BYTES:
                self.blocks.append(self._block(shapes[first:t], feature, rank))
                first, words, rows = t, 0, 0
            words, rows = words + own, rows + len(splits)
        self.blocks.append(self._block(shapes[first:], feature, rank))
        self.value = np.concatenate([value for _, value, _ in self.blocks])

    def __reduce__(self):
        return Scorer, (self.arrays,)  # the bits are made where they are used

    def _block(self, shapes, feature, rank):
        """(per feature the block's rank of every rank, and open leaves by that rank), values by column, columns by tree."""
        used = np.array([s[0] for _, splits in shapes for s in splits], np.int64)
        first = np.cumsum([0, *(-(-len(exits) // WORD) for exits, _ in shapes)])
        columns = int(first[-1])
        tables, own_rank = {}, {}
        for f in np.unique(feature[used]).tolist():
            cuts = np.unique(rank[used[feature[used] == f]])
            own_rank[f] = {r: i for i, r in enumerate(cuts.tolist())}
            place = np.searchsorted(cuts, np.arange(len(self.thresholds[f]) + 1), side="left")
            tables[f] = place, np.full((len(cuts) + 1, columns), (1 << WORD) - 1, np.uint64)
        value = np.zeros((columns, WORD + 1))  # the last one is that of a word without an open leaf
        for t, (exits, splits) in enumerate(shapes):
            for word, at in enumerate(range(int(first[t]), int(first[t + 1]))):
                low = word * WORD
                part = exits[low : low + WORD]
                value[at, : len(part)] = part
                every = (1 << len(part)) - 1
                for _, table in tables.values():
                    table[:, at] = every
                if not tables:  # a lone leaf
                    value[at] = part[0]
                for node, start, middle, end in splits:
                    f = int(feature[node])
                    table, r = tables[f][1], own_rank[f][int(rank[node])]
                    table[r + 1 :, at] &= np.uint64(every & ~self._stretch(start - low, middle - low))
                    table[: r + 1, at] &= np.uint64(every & ~self._stretch(middle - low, end - low))
        return tables, value, first

    @staticmethod
    def _stretch(first: int, end: int) -> int:
        first, end = max(first, 0), min(end, WORD)
        return (1 << end) - (1 << first) if first < end else 0

    @staticmethod
    def _top(root: int, feature, left, right) -> set[int]:
        """The splits of a large tree that are turned into bits: those with the most nodes below them, a word of exits in all."""
        order, size, todo = [], {}, [root]
        while todo:
            node = todo.pop()
            order.append(node)
            if feature[node] >= 0:
                todo += [int(left[node]), int(right[node])]
        for node in reversed(order):
            size[node] = 1 + (size[int(left[node])] + size[int(right[node])] if feature[node] >= 0 else 0)
        # a node has more below it than its children, so the largest ones hang together
        return set(sorted((n for n in order if feature[n] >= 0), key=lambda n: (-size[n], n))[: WORD - 1])

    @staticmethod
    def _leaves(root: int, feature, left, right, among: set[int] | None) -> tuple[list[int], list[tuple[int, int, int, int]]]:
        """Leaves from left to right, and per split (node, first leaf of its left side, of its right side, end).

        With ``among`` only those nodes are split, and the others met are leaves.
        """
        leaves: list[int] = []
        splits: list[tuple[int, int, int, int]] = []
        todo: list[tuple[int, int, int]] = [(root, -1, -1)]
        while todo:
            node, first, middle = todo.pop()
            if middle >= 0:
                splits.append((node, first, middle, len(leaves)))
            elif first >= 0:
                todo += [(node, first, len(leaves)), (int(right[node]), -1, -1)]
            elif feature[node] < 0 or (among is not None and node not in among):
                leaves.append(node)
            else:
                todo += [(node, len(leaves), -1), (int(left[node]), -1, -1)]
        return leaves, splits

    @staticmethod
    def _table(root: int, feature, rank, left, right, value, base: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """A tree's nodes as (first child, rank, feature) in one number, both children side by side, their values and places from ``base`` on."""
        nodes, child, at = [root], [], 0
        while at < len(nodes):
            node = nodes[at]
            if feature[node] < 0:
                child.append(at)
            else:
                child.append(len(nodes))
                nodes += [int(left[node]), int(right[node])]
            at += 1
        own, child = np.array(nodes), np.array(child, np.int64)
        leaf = feature[own] < 0
        r = np.where(leaf, (1 << RANK_BITS) - 1, rank[own])
        packed = (child + base) << (RANK_BITS + FEATURE_BITS) | r << FEATURE_BITS | np.where(leaf, 0, feature[own])
        return packed, value[own], {n: base + i for i, n in enumerate(nodes)}

    def total(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for low in range(0, len(x), WALK_ROWS):
            out[low : low + WALK_ROWS] = self._total(x[low : low + WALK_ROWS])
        return out

    def _total(self, x: np.ndarray) -> np.ndarray:
        n, d = x.shape
        ranks = {f: np.searchsorted(cuts, np.where(np.isnan(x[:, f]), -np.inf, x[:, f]), side="left") for f, cuts in self.thresholds.items()}
        flat = row = None
        if self.walked:
            width = 1 << (d - 1).bit_length()
            flat, row = np.zeros((n, width), np.int64), np.arange(n) * width
            for f, r in ranks.items():
                flat[:, f] = r << FEATURE_BITS
            flat = flat.ravel()
        total, t = np.zeros(n), 0
        for tables, value, first in self.blocks:
            own = {f: place.take(ranks[f]) for f, (place, _) in tables.items()}
            trees = len(first) - 1
            walked = [i for i in range(trees) if t + i in self.walked]
            found = np.empty((len(value) + 1, n))
            for low in range(0, n, BIT_ROWS):
                self._open(tables, value, own, slice(low, min(low + BIT_ROWS, n)), found)
            together = max(1, WALKERS // max(n, 1))
            for low in range(0, len(walked), together):
                lines = [first[i] + 1 for i in walked[low : low + together]]
                found[lines] = self._walk(flat, np.tile(row, len(lines)), found[lines].ravel().astype(np.int64)).reshape(len(lines), n)
            found[0] = total
            total = np.add.reduce(found, axis=0)  # one column after the other
            t += trees
        return total

    @staticmethod
    def _open(tables, value: np.ndarray, own: dict[int, np.ndarray], rows: slice, found: np.ndarray) -> None:
        """The value of every column's open leaf for the rows, into ``found`` from its second line on."""
        held = None
        for f, (_, table) in tables.items():
            part = table.take(own[f][rows], axis=0)
            held = part if held is None else np.bitwise_and(held, part, out=held)
        if held is None:
            found[1:, rows] = value[:, :1]
            return
        below = held - np.uint64(1)
        leaf = np.bitwise_count(np.bitwise_and(below, np.invert(held, out=held), out=below)).T  # the closed ones below the open one, all 64 if none is
        found[1:, rows] = value.ravel().take(leaf + (np.arange(len(value)) * (WORD + 1))[:, None])

    def _walk(self, flat: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The values of the leaves below the nodes ``at``, several trees side by side."""
        out, place, step = np.empty(len(at)), np.arange(len(at)), 0
        features = (1 << FEATURE_BITS) - 1
        while True:
            node = self.nodes.take(at)
            below = node >> (RANK_BITS + FEATURE_BITS)
            if step % 2 == 0:
                moving = below != at
                left = np.count_nonzero(moving)
                if left < 0.8 * len(at):
                    ended = np.flatnonzero(~moving)
                    out[place.take(ended)] = self.ends.take(at.take(ended))
                    if not left:
                        return out
                    moving = np.flatnonzero(moving)
                    place, row, below, node = place.take(moving), row.take(moving), below.take(moving), node.take(moving)
            step += 1
            column = node & features
            column |= row
            node &= LOW
            below += flat.take(column) > node
            at = below


def walk(x: np.ndarray, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sum of the leaf values of every row over all trees, one tree after the other: plain steps from node to node."""
    roots, feature, threshold, left, right, value = arrays
    (n, d), flat = x.shape, np.ascontiguousarray(x).ravel()
    total = np.zeros(n)
    for root in roots:
        row, at = np.arange(n), np.full(n, root)
        while len(row):
            f = feature.take(at)
            inner = f >= 0
            if not inner.all():
                ended = ~inner
                total[row[ended]] += value.take(at[ended])
                row, at, f = row[inner], at[inner], f[inner]
            beyond = flat.take(row * d + f) > threshold.take(at)
            at = np.where(beyond, right.take(at), left.take(at))
    return total
