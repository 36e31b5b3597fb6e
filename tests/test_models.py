"""Properties of the fitted detectors."""

import os
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import modelled
from checks.exact import EXACT, fin, raw_flows
from checks.modelled import classes
from flowarden.functions.scalars import BENIGN_TEXT, CORE_FEATURES, explanation_text
from flowarden.models import compare, histogram
from flowarden.models.attribution import Attributor, shapley_tables, shapley_values
from flowarden.models.compare import ISOLATION, compare_models
from flowarden.models.hybrid import HybridDetector
from flowarden.models.iforest import IsolationForest, average_path, grow_tree
from flowarden.models.supervised import fit_adaboost, fit_boosted_trees, fit_random_forest
from flowarden.operators import evaluate, sampling
from flowarden.plans import detection, studies
from flowarden.session import spread


@pytest.fixture(scope="module")
def cluster(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    rows += [(3000 + i, 9.0 + i, -8.0, 1) for i in range(15)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(5)


@pytest.fixture(scope="module")
def hybrid(spark, sf_dir):
    return detection.train_hybrid(*classes(spark, sf_dir), "flow_id", n=1500, forest_trees=30, trees=5)


def test_average_path():
    assert average_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(average_path(256)) == pytest.approx(10.2448, abs=1e-3)


@pytest.mark.parametrize("trees", [10, 60])  # own rows for each tree, and rows shared between trees
def test_planted_outliers_rank_first(cluster, trees):
    model = IsolationForest(trees, 128).fit(cluster, ["a", "b"], "id")
    scored = model.score(cluster)
    worst = {r["id"] for r in scored.orderBy("if_score").limit(15).collect()}
    assert len(worst & set(range(3000, 3015))) >= 13
    lo, hi = scored.agg(F.min("if_score"), F.max("if_score")).first()
    assert -1 <= lo < hi < 0
    share = evaluate.flag_by_contamination(scored, 0.02).agg(F.avg((F.col("if_label") == -1).cast("int"))).first()[0]
    assert share == pytest.approx(0.02, abs=0.003)


def test_forest_ignores_partitioning(cluster):
    fit = lambda df: IsolationForest(20, 64).fit(df, ["a", "b"], "id").nodes
    assert fit(cluster.repartition(3)).equals(fit(cluster.coalesce(1)))


def test_paths_agree_with_scores(spark, cluster):
    model = IsolationForest(1, 128).fit(cluster, ["a", "b"], "id")
    steps = model.trace_paths(cluster, "id").groupBy("id").agg(F.count("step").alias("n"))
    both = model.mean_path_length(cluster).join(steps, "id", "left")
    assert both.where(F.col("mean_path") != F.coalesce("n", F.lit(0))).count() == 0
    splits = model.split_counts(spark).agg(F.sum("splits")).first()[0]
    assert splits == (model.nodes["feature"] >= 0).sum()


def test_hybrid_learns_and_survives_storage(spark, sf_dir, hybrid, tmp_path):
    df = fin(spark, sf_dir)
    out = hybrid.transform(df)
    assert evaluate.roc_auc(out.withColumn("score", F.col("prob"))).first()[0] > 0.75
    hybrid.save(spark, str(tmp_path / "m"))
    again = HybridDetector.load(spark, str(tmp_path / "m")).transform(df)
    diff = out.select("flow_id", "prob", "if_score").exceptAll(again.select("flow_id", "prob", "if_score"))
    assert diff.count() == 0


def test_missing_features_read_as_medians(spark, sf_dir, hybrid):
    df = fin(spark, sf_dir).select("flow_id", "syn_flag")
    assert hybrid.transform(df).where("prob is null or if_score is null").count() == 0


def test_one_row_inference(spark, hybrid):
    # fixed values: one flow with known shape
    row = (50000.0, 100.0, 1000.0, 2000.0, 15.0, 1.0, 0.0, 0.0, 0.15, 200.0)
    df = spark.createDataFrame([("k", *row)], ["flow_id", *CORE_FEATURES])
    attribute = Attributor(spark, hybrid.booster.model, hybrid.input_names, hybrid.feature_names)
    got = attribute.transform(hybrid.transform(df, keep_inputs=True)).first()
    sizes = [abs(c["impact"]) for c in got["contributions"]]
    assert len(sizes) == 11 and sizes == sorted(sizes, reverse=True)


def test_contributions_add_up_to_log_odds(spark, sf_dir, hybrid):
    attribute = Attributor(spark, hybrid.booster.model, hybrid.input_names, hybrid.feature_names)
    out = attribute.transform(hybrid.transform(fin(spark, sf_dir), keep_inputs=True))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["impact"])
    gap = out.select(F.max(F.abs(total + F.lit(attribute.base) - F.log(F.col("prob") / (1 - F.col("prob")))))).first()[0]
    assert gap < 1e-9


def test_shapley_against_subsets():
    import itertools
    from math import factorial

    import pandas as pd

    # x0 <= 1 ? (x1 <= 2 ? 5 : -1) : (x0 <= 3 ? 2 : 7)
    nodes = pd.DataFrame(
        [(0, 0, 0.0, 10, 1, 4, 0, 1.0), (0, 1, 0.0, 6, 2, 3, 1, 2.0), (0, 2, 5.0, 4, -1, -1, -1, None), (0, 3, -1.0, 2, -1, -1, -1, None),
         (0, 4, 0.0, 4, 5, 6, 0, 3.0), (0, 5, 2.0, 1, -1, -1, -1, None), (0, 6, 7.0, 3, -1, -1, -1, None)],
        columns=["treeID", "id", "value", "cover", "left", "right", "feature", "threshold"],
    )
    by_id = {r.id: r for r in nodes.itertuples()}

    def value(x, known, at=0):
        n = by_id[at]
        if n.left < 0:
            return n.value
        if n.feature in known:
            return value(x, known, n.left if x[n.feature] <= n.threshold else n.right)
        return sum(by_id[c].cover / n.cover * value(x, known, c) for c in (n.left, n.right))

    trees, base = shapley_tables(nodes, [0.5])
    for x in itertools.product([0.5, 2.0, 4.0], [1.0, 3.0]):
        phi = shapley_values(np.array([x]), trees, 2)[0]
        for j in range(2):
            other = 1 - j
            w = factorial(0) * factorial(1) / factorial(2)
            expect = w * (value(x, {j}) - value(x, set())) + w * (value(x, {0, 1}) - value(x, {other}))
            assert phi[j] == pytest.approx(expect, abs=1e-12)
    assert base == pytest.approx(value((0, 0), set()))


def test_adaboost_separates(spark, cluster):
    out = fit_adaboost(cluster, ["a", "b"], "y", rounds=3).predict(cluster)
    assert evaluate.binary_metrics(out).first()["recall"] > 0.9


def test_compare_has_one_row_per_model_and_set(cluster):
    rows, hybrid = compare_models(cluster, {"same": cluster}, ["a", "b"], key="id", models=(ISOLATION,), forest_trees=20)
    r = rows.first()
    assert hybrid is None and rows.count() == 1 and r["eval_set"] == "same" and r["roc_auc"] > 0.95


def test_offline_report(spark, sf_dir, hybrid, tmp_path):
    path = str(tmp_path / "history")
    rep = detection.offline_detect(raw_flows(spark, sf_dir), hybrid, "flow_id", explain=True, history_path=path)
    n = raw_flows(spark, sf_dir).count()
    s = rep.summary.first()
    assert s["total_flows"] == n == s["anomalies"] + s["normal"]
    assert rep.shown.count() <= 100 and rep.timeline.count() == 12 and rep.metrics.first()["f1"] > 0.3
    assert rep.attacks.agg(F.sum("n")).first()[0] == s["anomalies"]
    flagged = rep.scored.where("is_anomaly = 1").select("contributions", "explanation_text").first()
    assert len(flagged["contributions"]) == 11 and flagged["explanation_text"].startswith("The")
    stored = spark.read.parquet(path)
    assert stored.count() == n == stored.select("id").distinct().count()


def test_flow_report_tables(spark, sf_dir):
    study = studies.flow_report(*classes(spark, sf_dir), "flow_id", n=800, trees=30)
    c = study["confusion"].first()
    # 800 rows of each class fit the model; all rows are scored and reported
    assert sum(c) == raw_flows(spark, sf_dir).count() and study["series"].count() == 288
    assert study["alerts"].groupBy("type", "bucket").count().where("count > 1").count() == 0


def test_all_feature_study(spark, sf_dir):
    base = spark.createDataFrame([("f1", 0.5)], "metric string, value double")
    study = studies.all_feature_run(*classes(spark, sf_dir), "flow_id", base, n=500, trees=20)
    assert "URG Flag Cnt" not in study.scored.columns and study["delta"].count() == 1
    assert 0 < study["best_threshold"].first()["f1"] <= 1


def test_dataset_comparison_tables(spark, sf_dir):
    study = studies.dataset_comparison(*classes(spark, sf_dir), "flow_id", ["Flow Byts/s", "Flow Pkts/s", "SYN Flag Cnt", "RST Flag Cnt", "Pkt Len Mean"], n=500, trees=20)
    assert study["sweep"].count() == 15 and study["kde"].count() == 1000
    area = study["kde"].groupBy("class").agg(((F.max("x") - F.min("x")) * F.avg("density")).alias("a")).collect()
    assert all(r["a"] == pytest.approx(1, abs=0.05) for r in area)
    d = {r["feature"]: r["cohens_d"] for r in study["cohens_d"].collect()}
    assert d["SYN Flag Cnt"] > 0.5


def test_rows_outside_the_sample_are_unseen(spark, sf_dir):
    total = raw_flows(spark, sf_dir).count()
    metrics = studies.algorithm_comparison(*classes(spark, sf_dir), "flow_id", n=300, forest_trees=5, trees=2, rounds=2).collect()
    cells = {(r["model"], r["eval_set"]): r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in metrics}
    assert len(cells) == 8 and {cells[k] for k in cells if k[1] == "test"} == {120} and {cells[k] for k in cells if k[1] == "unseen"} == {total - 600}
    metrics = studies.rigorous_eval(*classes(spark, sf_dir), "flow_id", n=300, k=2, forest_trees=5, trees=2, rounds=2)["metrics"].collect()
    assert {r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in metrics if r["eval_set"] == "unseen"} == {total - 480}


def test_folds_are_fitted_on_all_rows_of_the_others(cluster, monkeypatch):
    """The registered queries fit every fold on four fifths of the whole table, not on a draw from them."""
    fitted, called = [], []
    monkeypatch.setattr(compare.HybridDetector, "fit", lambda df, *args, **kwargs: fitted.append({r["flow_id"] for r in df.collect()}) or called.append(kwargs) or HybridFit())
    rows = cluster.withColumnRenamed("id", "flow_id").withColumns({f: F.col("a") for f in CORE_FEATURES})
    monkeypatch.setattr(modelled, "fin", lambda s, d: rows)
    monkeypatch.setattr(modelled, "FIT_ROWS", 5)
    for query in (modelled.MODELLED["m10_cross_validate"], EXACT["m10_folds_hold_every_row"][0]):
        fitted.clear()
        held = query(cluster.sparkSession, "").collect()
        assert len(held) == 5 and [len(ids) for ids in fitted] == [2412] * 5
        for i in range(3015):
            assert sum(i in ids for ids in fitted) == 4


class HybridFit:
    """A detector that flags nothing."""

    def transform(self, df):
        return df.withColumn("pred", F.lit(0))


def test_boosting_over_a_table_stores_its_scores(cluster, monkeypatch):
    """More trees than are kept between two stored scores: the same trees as inside one task, and no pass for the last level."""
    monkeypatch.setattr(histogram, "STORED_TREES", 2)
    passes = []
    level = histogram.TableSums.level
    monkeypatch.setattr(histogram.TableSums, "level", lambda self, *args: passes.append(1) or level(self, *args))
    noisy = cluster.withColumn("y", ((F.col("a") + F.col("b") + F.col("id") % 3) > 1).cast("int"))
    over, inside = (fit_boosted_trees(noisy, ["a", "b"], "y", trees=5, depth=2, task_rows=n).model.nodes for n in (0, 10_000))
    assert over.equals(inside)
    assert over["treeID"].nunique() == 5 and len(passes) == 10
    stumps = [fit_adaboost(noisy, ["a", "b"], "y", 5, task_rows=n).stumps for n in (0, 10_000)]
    assert stumps[0] == stumps[1] and len(stumps[0]) > 3


def test_boosting_sums_the_lighter_children_alone(spark, cluster, monkeypatch):
    """Over a table: one slot for each pair of children, and nothing is kept in the executors or on disk after the fit."""
    asked, kept = [], []
    level, drop = histogram.TableSums.level, histogram.TableSums._delete
    monkeypatch.setattr(histogram, "STORED_TREES", 2)
    monkeypatch.setattr(histogram.TableSums, "level", lambda self, tree, slots, n: asked.append((tree.levels, n)) or level(self, tree, slots, n))
    monkeypatch.setattr(histogram.TableSums, "_delete", lambda self, rows: kept.append(rows.getCheckpointFile()) or drop(self, rows))
    noisy = cluster.withColumn("y", ((F.col("a") + F.col("b") + F.col("id") % 3) > 1).cast("int"))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    over, inside = (fit_boosted_trees(noisy, ["a", "b"], "y", trees=6, depth=4, task_rows=n).model.nodes for n in (0, 10_000))
    assert over.equals(inside)
    assert {n for at, n in asked if at < 2} == {1} and max(n for at, n in asked if at == 3) in (3, 4)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    stored = [path for path in kept if path]
    assert len(stored) >= 2 and not any(os.path.exists(path.removeprefix("file:")) for path in stored)


@pytest.mark.parametrize("features", [2, 9])
def test_column_comparisons_place_rows_like_single_steps(features):
    rng = np.random.default_rng(features)
    bins, y = rng.integers(0, 256, (features, 700)).astype(np.uint8), rng.integers(0, 2, 700)
    tree = histogram.HeapTree.empty(4)
    tree.value = rng.normal(size=tree.value.shape)
    for at in range(15):  # some branches end early
        if at == 0 or (tree.feature[(at - 1) // 2] >= 0 and rng.random() < 0.8):
            tree.feature[at], tree.cut[at] = rng.integers(features), rng.integers(255)
    tree.levels = 4
    want = []
    for i in range(700):
        at = 0
        while at < 15 and tree.feature[at] >= 0:
            at = 2 * at + 1 + int(bins[tree.feature[at], i] > tree.cut[at])
        want.append(tree.value[at, y[i]])
    assert tree.gain(bins, y).tolist() == want


def forest_rows(bins, y, n, size):
    """The rows as a task gets them, in blocks of ``size``."""
    starts = {(0, i): low for i, low in enumerate(range(0, len(y), size))}
    blocks = [
        pa.RecordBatch.from_pydict({"part": [0], "block": [i], "bins": [bins[:, low : low + size].tobytes()], "y": [y[low : low + size].tobytes()], "n": [n[low : low + size].tobytes()]})
        for (_, i), low in starts.items()
    ]
    return histogram.ForestRows(iter(blocks[::-1]), len(bins), starts, len(y))


@pytest.mark.parametrize("held", [150, 10_000])
def test_forest_trees_hold_all_their_draws(held):
    """Nodes split over blocks and nodes split in memory: covers and values are those of the draws, and leaves are grown out."""
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 30, (4, 2000)).astype(np.uint8)
    bins[0] //= 10
    y, n = ((rng.random(2000) < 0.3) | (bins[1] > 24)).astype(np.int8), rng.integers(1, 5, 2000)
    nodes = histogram.ForestTree([np.arange(30.0)] * 4, 2, np.random.default_rng(8)).grow(forest_rows(bins, y, n, 333), held).nodes()
    drawn = forest_rows(bins, y, n, 2000).drawn(np.random.default_rng(8))  # blocks do not matter
    assert drawn.sum() == n.sum() and 0.5 < (drawn > 0).mean() < 0.99
    at = np.zeros(2000, int)
    for i, (node, feature, threshold, left, right, value, cover) in enumerate(nodes):
        own = (at == i) & (drawn > 0)
        assert node == i and cover == drawn[own].sum()
        if feature >= 0:
            assert right == left + 1 > i + 1
            at[at == i] = left + (bins[feature, at == i] > threshold)
        else:
            assert value == (drawn * y)[own].sum() / cover
            assert value in (0, 1) or (bins[:, own] == bins[:, own][:, :1]).all()


def test_forest_draws_from_all_rows(cluster):
    """However few rows a task holds, every tree draws as many rows as the table has, whatever their partitions."""
    grown = [fit_random_forest(df, ["a", "b"], "y", trees=3, held_rows=200).model.nodes for df in (cluster, cluster.repartition(3))]
    assert grown[0].equals(grown[1])
    roots = grown[0][grown[0]["id"] == 0]
    assert roots["cover"].tolist() == [3015.0] * 3
    leaves = grown[0][grown[0]["feature"] < 0]
    assert leaves.groupby("treeID")["cover"].sum().tolist() == [3015.0] * 3 and set(leaves["value"]) == {0.0, 1.0}


def test_leaf_bits_agree_with_plain_steps():
    """Trees of one leaf, of one word, of several words and too large for bits, over missing and infinite values."""
    rng = np.random.default_rng(3)
    nodes = []
    for t, (rows, depth) in enumerate([(1, 1), (40, 6), (256, 8), (256, 40), (3000, 60), (90, 9)]):
        grown = {n[0]: n for n in grow_tree(rng.lognormal(size=(rows, 4)).round(2), depth, rng)}
        number = {n: i for i, n in enumerate(sorted(grown))}  # ids of deep trees outgrow an int
        nodes += [(t, number[i], f, cut, number.get(left, -1), number.get(right, -1), float(rng.normal()) if f < 0 else 0.0, 1.0) for i, f, cut, left, right, _, _ in grown.values()]
    arrays = histogram.NodeTrees(pd.DataFrame(nodes, columns=histogram._names(histogram.NODES))).arrays()
    x = rng.lognormal(size=(9000, 4)).round(2)
    x[::7, 0], x[::11, 1], x[::13, 2] = np.nan, np.inf, -np.inf
    scorer = pickle.loads(pickle.dumps(histogram.Scorer(arrays)))
    assert len(scorer.walked) == 1 and scorer.value.shape[0] > 5
    assert np.array_equal(scorer.total(x), histogram.walk(x, arrays))
    assert scorer.total(x[:0]).shape == (0,)
    alone = histogram.Scorer((np.array([0]), np.array([-1]), np.array([np.nan]), np.array([0]), np.array([0]), np.array([0.25])))
    assert alone.total(x[:600]).tolist() == [0.25] * 600

def test_tables_with_enough_splits_stay_in_place(spark, tmp_path):
    """A share of a table dealt over the cores grows with it: only tables of small splits are dealt."""
    spark.range(50_000).coalesce(1).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    wide = ids.select(*[F.col("id").alias(f"c{i}") for i in range(600 * spark.sparkContext.defaultParallelism)])
    size = int(str(wide._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    assert cores * 8 * 1024 * 1024 < size <= cores * 128 * 1024 * 1024
    assert spread(wide) is wide and spread(ids) is not ids


def test_both_classes_are_drawn_together(cluster, monkeypatch):
    """The rows of one draw for each class, from one stored table."""
    stored = []
    store = sampling.materialise
    monkeypatch.setattr(sampling, "materialise", lambda df, label: stored.append(label) or store(df, label))
    got = {r["id"] for r in sampling.sample_per_class(cluster, 20, 7, "id", "y").collect()}
    assert len(stored) == 1
    want = [sampling.sample_n(cluster.where(F.col("y") == k), 20, 7, "id") for k in (0, 1)]
    assert got == {r["id"] for df in want for r in df.collect()} and len(got) == 35



def test_many_trees_stay_leaf_bits():
    """Bits are kept for blocks of trees that fit a cache, however many trees; large trees are walked from their top's exits, side by side."""
    rng = np.random.default_rng(5)
    nodes = []
    for t, (rows, depth) in enumerate([(256, 8)] * 150 + [(2000, 30)] * 3 + [(256, 8)] * 20):
        grown = {n[0]: n for n in grow_tree(rng.lognormal(size=(rows, 6)), depth, rng)}
        number = {n: i for i, n in enumerate(sorted(grown))}
        nodes += [(t, number[i], f, cut, number.get(left, -1), number.get(right, -1), float(rng.normal()) if f < 0 else 0.0, 1.0) for i, f, cut, left, right, _, _ in grown.values()]
    arrays = histogram.NodeTrees(pd.DataFrame(nodes, columns=histogram._names(histogram.NODES))).arrays()
    scorer = histogram.Scorer(arrays)
    assert sorted(scorer.walked) == [150, 151, 152] and len(scorer.blocks) > 3
    for tables, _, _ in scorer.blocks:
        assert sum(table.nbytes for _, table in tables.values()) <= 2 * histogram.BLOCK_BYTES
    x = rng.lognormal(size=(5000, 6))
    x[::9, 4] = np.nan
    assert np.array_equal(scorer.total(x), histogram.walk(x, arrays))


def test_attribution_scores_a_row_once(spark, sf_dir, hybrid, tmp_path):
    """Flagged rows get what they get alone, the others an empty list, and the table is read and scored in one pass."""
    fin(spark, sf_dir).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    attribute = Attributor(spark, hybrid.booster.model, hybrid.input_names, hybrid.feature_names)
    out = detection.score_flows(rows, hybrid, 0.5, attribute)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = {r["flow_id"]: r for r in out.collect()}
    flagged = {i for i, r in got.items() if r["is_anomaly"]}
    alone = attribute.transform(hybrid.transform(rows, keep_inputs=True).where(F.col("flow_id").isin(sorted(flagged)[:500])))
    alone = alone.collect()
    assert len(alone) == min(500, len(flagged)) > 0 and len(flagged) < len(got)
    for r in alone:
        one, other = ({c["feature"]: c["impact"] for c in row["contributions"]} for row in (r, got[r["flow_id"]]))
        assert one.keys() == other.keys() and all(abs(one[f] - other[f]) < 1e-9 for f in one)
    ranked_again = out.select("flow_id", explanation_text("contributions").alias("t")).collect()
    assert all(got[r["flow_id"]]["explanation_text"] == r["t"] for r in ranked_again if r["flow_id"] in flagged)
    assert all(bool(r["contributions"]) == (i in flagged) for i, r in got.items())
    assert {r["explanation_text"] for i, r in got.items() if i not in flagged} == {BENIGN_TEXT}


def test_curves_of_a_study_group_the_rows_once(spark, sf_dir, monkeypatch):
    stored = []
    store = evaluate.materialise
    monkeypatch.setattr(evaluate, "materialise", lambda df, label: stored.append(label) or store(df, label))
    made = studies.dataset_comparison(*classes(spark, sf_dir), "flow_id", ["Flow Duration", "SYN Flag Cnt", "Pkt Len Mean", "Flow Pkts/s"], trees=5)
    assert stored.count("per-score") == 1
    for name, alone in (("roc", evaluate.roc_curve), ("roc_auc", evaluate.roc_auc), ("pr", evaluate.pr_curve), ("average_precision", evaluate.average_precision)):
        a, b = (sorted([round(v, 9) if v is not None else -1.0 for v in r] for r in df.collect()) for df in (made[name], alone(made.scored)))
        assert a == b and a
