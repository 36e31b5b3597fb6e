"""Nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately, so a pair of codebook entries names a cell. A query scores both
codebooks against its own halves, walks centroid pairs from the best summed score downwards with a heap, and takes
the cells it meets until they hold enough entries; all of these are reranked by the exact inner product on the
original vectors. How many are enough is measured, not set: on the sample the codebooks are fitted on, the smallest
share of entries that gives ``RECALL`` against brute force. Clustered vectors need little, unstructured ones much.

* Codebooks are fitted by k-means on a bounded sample (``SAMPLE_ROWS`` expected rows, chosen by a hash of the id) and
  hold at most ``MOST_CENTROIDS`` entries each, so the model and the table of cell sizes are bounded. Every row is
  indexed.
* Equal vectors collapse to one entry with its smallest ids: of more copies than a query returns, no further one can
  be among its answers (ties go to the smaller id). Equal queries are searched once. A vector that makes up a third
  of the table is so one entry and one query.
* Neighbouring cells form shards of about ``SHARD_ROWS`` entries, and a cell above that is cut into blocks by a hash,
  so a crowded cell is several tasks' work. A query is sent once to each shard it visits, which answers with its own
  best entries; candidates are never shuffled.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowarden.session import materialise

MOST_CENTROIDS = 1024
CELL_ROWS = 12  # entries to a cell that the number of centroids aims at
SAMPLE_ROWS = 20_000
ROUNDS = 12
SEED = 7
NEAREST = 20
RECALL = 0.96  # aimed at on the sample
SAMPLE_QUERIES = 100
DENSE = 0.1  # from this share of a shard's entries on, all of them are multiplied at once
SHARD_ROWS = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> DataFrame:
    """``(id, v)`` of the rows that take part: an id, a vector of the common width, finite throughout and not zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    return rows if width is None else rows.where(F.size("v") == width)


def _kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    points = np.unique(points, axis=0)
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        near = ((centres**2).sum(1) / 2 - points @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(entries: DataFrame, rows: int, centroids: int, sample_rows: int = SAMPLE_ROWS, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray, float]:
    """Codebooks of both halves, and the share of all entries to probe. No entry: empty ones."""
    share = min(1.0, sample_rows / max(1, rows))
    # of 2^62 hash values, so that no table is too large for the share
    sample = entries.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 62)) < int(share * (1 << 62))).select("v").toPandas()["v"]
    if not len(sample):
        sample = entries.limit(1).select("v").toPandas()["v"]
    points = np.unique(np.array(sample.tolist()), axis=0)
    cut = points.shape[1] // 2
    one, two = _kmeans(points[:, :cut], centroids), _kmeans(points[:, cut:], centroids)
    return one, two, _probe_share(points, one, two, nearest)


def _probe_share(points: np.ndarray, one: np.ndarray, two: np.ndarray, nearest: int) -> float:
    """Smallest share of the sample, in the order of cells, that holds ``RECALL`` of the queries' nearest."""
    if len(points) <= 4 * nearest:
        return 1.0
    cut = points.shape[1] // 2
    first, second = _nearest(points[:, :cut], one), _nearest(points[:, cut:], two)
    asked = points[np.random.default_rng(SEED).permutation(len(points))[:SAMPLE_QUERIES]]
    needed = []
    for q in asked:
        best = np.argpartition(-(points @ q), nearest)[: nearest + 1]
        score = (one @ q[:cut])[first] + (two @ q[cut:])[second]
        needed.append(np.searchsorted(np.sort(-score), -score[best], "right"))
    return min(1.0, float(np.quantile(np.concatenate(needed), RECALL)) / len(points))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) / 2 - points @ centres.T).argmin(1)


def best_cells(first: np.ndarray, second: np.ndarray, filled: np.ndarray, want: int) -> list[int]:
    """Cells in descending summed score until they hold ``want`` entries (multi-sequence walk; empty cells are passed)."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen, cells, held = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i] * len(second) + b[j])
        if filled[cell]:
            cells.append(cell)
            held += int(filled[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))
    return cells


def _shards(filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its shard and the number of blocks that shard is cut into."""
    shard, blocks = np.zeros(len(filled), np.int64), np.maximum(1, -(-filled // SHARD_ROWS))
    number, held = 0, 0
    for cell, n in enumerate(filled.tolist()):
        if held and held + n > SHARD_ROWS:
            number, held = number + 1, 0
        shard[cell] = number
        held += n
    return shard, blocks


def _entries(sound: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids. The rank is limited before the shuffle, so copies stay where they are."""
    order = Window.partitionBy("v").orderBy("id")
    low = sound.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= keep)
    return low.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("id", F.col("ids")[0])


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    nearest: int = NEAREST, sample_rows: int = SAMPLE_ROWS, probe_share: float | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query its ``nearest`` rows by inner product, itself apart.

    ``probe_share`` sets the share of entries to look at instead of the measured one. Ties go to the smaller id. Rows without an id, with a null, zero or non-finite vector, or of another width than
    most rows take no part, as candidates and as queries. Rows that agree in id and vector are one; a query never
    meets its own id. Fewer candidates than ``nearest`` give fewer rows; an empty table none.
    """
    spark = vectors.sparkSession
    widths = usable(vectors, id_col, vector_col).groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, keep = widths["w"], nearest + 1
    entries = materialise(_entries(usable(vectors, id_col, vector_col, width), keep), "entries")
    rows = entries.count()
    centroids = int(min(MOST_CENTROIDS, max(2, round((rows / CELL_ROWS) ** 0.5))))
    one, two, measured = fit(entries, rows, centroids, sample_rows, nearest)
    cut = width // 2

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        points = np.array(v.tolist()).reshape(len(v), width)
        return pd.Series(_nearest(points[:, :cut], one) * len(two) + _nearest(points[:, cut:], two), dtype="int32")

    placed = materialise(entries.withColumn("cell", cell_of("v")), "index")
    filled = np.zeros(len(one) * len(two), np.int64)
    for r in placed.groupBy("cell").count().collect():  # centroids^2 rows at most
        filled[r["cell"]] = r["count"]
    shard, blocks = _shards(filled)
    want = max(4 * keep, int(np.ceil((probe_share or measured) * rows)))

    @F.pandas_udf("struct<shard:int,block:int>")
    def shard_of(cell: pd.Series, key: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shard": shard[cell].astype("int32"), "block": (key.to_numpy().view("uint64") % blocks[cell].astype("uint64")).astype("int32")})

    @F.pandas_udf("array<struct<shard:int,block:int,cells:array<int>>>")
    def visits(v: pd.Series) -> pd.Series:
        out = []
        for q in v:
            to: dict[tuple[int, int], list[int]] = {}
            for c in best_cells(one @ q[:cut], two @ q[cut:], filled, want):
                for b in range(int(blocks[c])):
                    to.setdefault((int(shard[c]), b), []).append(c)
            out.append([{"shard": s, "block": b, "cells": c} for (s, b), c in to.items()])
        return pd.Series(out)

    def meet(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"search": [], "hits": []})
        held = held.sort_values(["cell", "id"], ignore_index=True)
        cells, ids, points = held["cell"].to_numpy(), held["id"].to_numpy(), np.array(held["v"].tolist())
        names, edge = np.unique(cells, return_index=True)
        edge = np.append(edge, len(cells))
        answers = []
        for q, own in zip(asking["q"], asking["cells"]):
            at = np.searchsorted(names, own)
            size = edge[at + 1] - edge[at]
            if size.sum() >= DENSE * len(cells):
                met = np.zeros(len(names), bool)
                met[at] = True
                rows_ = np.flatnonzero(np.repeat(met, np.diff(edge)))
                rough = (points @ q)[rows_]
            else:
                rows_ = np.repeat(edge[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                rough = points[rows_] @ q
            if len(rows_) > keep:  # with room for rounding
                rows_ = rows_[rough >= np.partition(rough, len(rough) - keep)[len(rough) - keep] - 1e-9 * np.abs(rough).max()]
            score = (points[rows_] * q).sum(1)  # added up in one order, so equal vectors score equal wherever they are met
            near = np.lexsort((ids[rows_], -score))
            answers.append([{"low": float(-score[k]), "ids": held["ids"].iat[rows_[k]].tolist()} for k in near])
        return pd.DataFrame({"search": asking["search"].to_numpy(), "hits": answers})

    # the entry of a query's vector names its search, so equal queries share one; a query outside the table has its own
    asked = usable(queries, id_col, vector_col, width).distinct()
    named = asked.join(placed.select("v", F.col("id").alias("entry")), "v", "left")
    named = materialise(named.select("id", "v", F.coalesce(F.concat(F.lit("e"), "entry"), F.concat(F.lit("q"), F.xxhash64("id", "v"))).alias("search")), "queries")
    # few bytes but much to compute: dealt over all cores, not merged into a few tasks
    distinct = named.groupBy("search").agg(F.first("v").alias("v")).repartition(2 * spark.sparkContext.defaultParallelism)
    routes = distinct.withColumn("to", F.explode(visits("v")))
    routes = routes.select("search", F.col("v").alias("q"), "to.shard", "to.block", "to.cells")
    index = placed.withColumn("at", shard_of("cell", F.xxhash64("id"))).select("id", "ids", "v", "cell", "at.shard", "at.block")
    hits = routes.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInPandas(meet, "search string, hits array<struct<low:double,ids:array<long>>>")
    flat = hits.select("search", F.explode("hits").alias("h")).select("search", "h.low", F.explode("h.ids").alias("vec_id"))
    top = Window.partitionBy("search").orderBy("low", "vec_id")
    flat = flat.withColumn("n", F.row_number().over(top)).where(F.col("n") <= keep).select("search", "low", "vec_id")
    found = named.select(F.col("id").alias("query_id"), "search").join(flat, "search").where("vec_id <> query_id")
    last = Window.partitionBy("query_id", "search").orderBy("low", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", (-F.col("low")).alias("score"))
