"""Range-wise ranks, narrowing quantiles and segment folds against plain Python, with skew."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.exact import raw_flows
from checks.modelled import classes
from flowarden.functions import scalars
from flowarden.functions.scalars import IMPACT_TYPE
from flowarden.operators import alerts, features, history, ordered, quantiles, sampling
from flowarden.plans import detection, studies
from flowarden.sources import tables


@pytest.fixture
def skewed(spark):
    # two thirds of the rows share one group and one sort value
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if rng.random() < 0.66 else f"g{i % 7}", 0.0 if rng.random() < 0.66 else float(rng.normal())) for i in range(6000)]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(7), rows


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_over_many_ranges(skewed, by):
    df, rows = skewed
    got = {r["id"]: r["rank"] for r in ordered.ranked(df, ["v", "id"], by=by, ranges=16).collect()}
    expect, seen = {}, {}
    for i, g, v in sorted(rows, key=lambda r: (r[2], r[0])):
        group = g if by else None
        seen[group] = seen.get(group, 0) + 1
        expect[i] = seen[group]
    assert got == expect


def test_running_sums_over_many_ranges(skewed):
    df, rows = skewed
    out = ordered.running(df, ["v", "id"], {"total": F.col("id")}, ranges=16)
    got = {r["id"]: r["total"] for r in out.collect()}
    total, expect = 0, {}
    for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        total += i
        expect[i] = total
    assert got == expect


def test_range_count_follows_the_row_count(skewed, monkeypatch):
    df, _ = skewed
    plain = ordered.ranked(df, ["v", "id"])
    assert "Broadcast" not in plain._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 500)
    cut = ordered.ranked(df, ["v", "id"])
    assert "Broadcast" in cut._jdf.queryExecution().executedPlan().toString()
    assert plain.exceptAll(cut).count() == 0


def test_group_totals_come_along(skewed):
    df, rows = skewed
    for ranges in (1, 16):
        out = ordered.running(df, ["v", "id"], {"pos": F.lit(1)}, ["g"], ranges, {"pos": "size"})
        got = {r["g"]: (r["n"], r["size"]) for r in out.groupBy("g").agg(F.count("id").alias("n"), F.max("size").alias("size")).collect()}
        assert all(n == size for n, size in got.values()) and sum(n for n, _ in got.values()) == len(rows)


@pytest.mark.parametrize("rest", [True, False])
@pytest.mark.parametrize("ranges", [None, 1, 16, 300])
def test_run_totals_equal_those_of_ranked_rows(skewed, ranges, rest):
    df, rows = skewed
    size, runs = len(rows) // 13, 12
    expect = {}
    for pos, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[0]))):
        run = min(pos // size + 1, runs) if rest else pos // size + 1
        if run <= runs:
            total, ids = expect.get(run, (0, 0))
            expect[run] = total + 1, ids + i
    got = ordered.run_totals(df, ["v", "id"], size, {"ids": "id"}, runs, rest, ranges)
    assert {r["run"]: (r["total"], r["ids"]) for r in got.collect()} == expect


def test_timeline_ranks_rows_of_border_ranges_only(spark, monkeypatch):
    n, ranked = 20_000, []
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("hit"))
    within = ordered._within
    monkeypatch.setattr(ordered, "_within", lambda *args: ranked.append(within(*args)) or ranked[-1])
    rows = alerts.timeline_bins(df, ["k"], "hit").collect()
    assert sum(r["normal"] + r["attacks"] for r in rows) == n and sum(r["attacks"] for r in rows) == -(-n // 3)
    assert 1 <= len(ranked) <= 11 and sum(df.where(c).count() for c in ranked) < n / 8


def test_range_ids_stay_compiled(spark, request):
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.enabled", "true"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # code of a plan is known before it runs
    df = spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    plan = ordered.ranked(df, ["k"], ranges=400)._jdf.queryExecution().executedPlan()
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) < 8000  # larger methods are interpreted


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, -0.00001, 0.00005, -0.00005, 1.00005, 2.5, 1e-300, 1e15, 1e300, 2.0**36 + 0.00005, float("nan"), float("inf"), float("-inf"), None]
    values += [float(x) for x in rng.integers(-(10**9), 10**9, 4000) / 1e5] + [float(x) for x in rng.normal(size=4000) * 10.0 ** rng.integers(-6, 14, 4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(scalars.rounded("v").alias("got"), F.round("v", 4).alias("want")).collect()
    assert [struct.pack("d", r["got"]) if r["got"] is not None else None for r in rows] == [struct.pack("d", r["want"]) if r["want"] is not None else None for r in rows]


def test_ranks_by_hash_are_those_of_the_order(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 1000 != 7, F.md5(F.col("id").cast("string"))).alias("h")).repartition(5)
    expect = {r["id"]: r["rank"] for r in ordered.ranked(df, ["h", "id"], ranges=1).collect()}
    got = ordered.ranked_by_hash(df, "h", "id", 5000)
    assert got.columns == ["id", "rank"] and {r["id"]: r["rank"] for r in got.collect()} == expect


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_ranks_by_range_are_those_of_the_order(skewed, ranges):
    """Also with a key that is missing here and there; rows come out in their order, a range a task."""
    df = skewed[0].withColumn("v", F.when(F.col("id") % 50 != 3, F.col("v")))
    expect = {r["id"]: r["rank"] for r in ordered.ranked(df, ["v", "id"], ranges=1).collect()}
    got = ordered.ranked_by_range(df, ["v", "id"], "rank", ranges)
    assert got.columns == ["id", "g", "v", "rank"]
    rows = got.collect()
    assert {r["id"]: r["rank"] for r in rows} == expect and [r["rank"] for r in rows] == sorted(expect.values())
    assert ranges is None or got.rdd.getNumPartitions() <= ranges + 1


def test_history_moves_narrow_rows_only(spark, sf_dir, tmp_path, monkeypatch):
    """Scored rows are stored once, in key order and without what follows from them, and go to the history unsorted."""
    stored = {}
    store = detection.materialise
    monkeypatch.setattr(detection, "materialise", lambda df, label, *args: stored.setdefault(label, (df.columns, store(df, label, *args)))[1])
    model = detection.train_hybrid(*classes(spark, sf_dir), "flow_id", n=300, forest_trees=5, trees=3)
    monkeypatch.setattr(tables, "ranked", None)
    path = f"{tmp_path}/history"
    rep = detection.offline_detect(raw_flows(spark, sf_dir), model, "flow_id", explain=True, history_path=path)
    columns, rows = stored["offline"]
    assert "flow_details" not in columns and "flow_details" in rep.scored.columns and "__pos" not in rep.scored.columns
    expect = {r["rank"]: r for r in ordered.ranked(rep.scored, ["flow_id"], ranges=1).select("rank", "flow_id", "prob", F.to_json("contributions").alias("c")).collect()}
    got = {r["id"]: r for r in spark.read.parquet(path).collect()}
    assert got.keys() == expect.keys() and len(got) == raw_flows(spark, sf_dir).count()
    assert all(got[i]["xgb_prob"] == r["prob"] and got[i]["shap_explanation"] == r["c"] for i, r in expect.items())
    assert {r["__pos"]: r["flow_id"] for r in rows.select("__pos", "flow_id").collect()} == {i: r["flow_id"] for i, r in expect.items()}


def test_flow_report_reads_the_flows_once(spark, sf_dir, monkeypatch):
    """Rows are put in random order without a sample of their keys, and stand on the clock as before."""
    both = sampling.label_union(*classes(spark, sf_dir), "y").withColumn("__h", sampling.hash_order("flow_id", 42))
    expect = {r["flow_id"]: r["timestamp"] for r in features.synth_timestamps(both, ["__h", "flow_id"]).select("flow_id", "timestamp").collect()}
    monkeypatch.setattr(ordered, "_range_bounds", None)
    report = studies.flow_report(*classes(spark, sf_dir), "flow_id", trees=5)
    assert {r["flow_id"]: r["timestamp"] for r in report.scored.select("flow_id", "timestamp").collect()} == expect


def test_unbounded_offsets_join_instead_of_broadcast(skewed, monkeypatch):
    df, rows = skewed
    expect = {r["id"]: r["rank"] for r in ordered.ranked(df, ["v", "id"], by=["g"], ranges=16).collect()}
    monkeypatch.setattr(ordered, "MAX_OFFSETS", 2)
    assert {r["id"]: r["rank"] for r in ordered.ranked(df, ["v", "id"], by=["g"], ranges=16).collect()} == expect


def test_ranges_are_really_cut(skewed):
    df, _ = skewed
    plan = ordered.ranked(df, ["v", "id"], ranges=16)._jdf.queryExecution().toString()
    assert "__range" in plan


@pytest.mark.parametrize("limit", [5, 50, 100_000])
def test_quantiles_equal_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "GATHER_LIMIT", limit)
    rng = np.random.default_rng(3)
    a = np.concatenate([np.zeros(1500), rng.lognormal(0, 5, 1500), -rng.random(40)])
    b = rng.integers(0, 4, len(a)).astype(float)
    rows = [(float(x), None if i % 11 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.995, 1.0]
    got = quantiles.exact_quantiles(df, {"a": probs, "b": probs})
    kept = [y for _, y in rows if y is not None]
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)), rel=1e-12)
    assert got["b"] == pytest.approx(list(np.quantile(kept, probs)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "a double")
    assert quantiles.exact_quantiles(df, {"a": [0.5]}) == {"a": [None]}


def fold(rows, gap):
    """The sequential rule, row by row."""
    out, by_type = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_type.setdefault(r[3], []).append(r)
    for group in by_type.values():
        rep = group[0]
        for cur in group[1:]:
            if cur[1] - rep[1] <= gap:
                if cur[4] < rep[4]:
                    rep = cur
            else:
                out.append(rep)
                rep = cur
        out.append(rep)
    return {r[0] for r in out}


@pytest.mark.parametrize("shape", ["random", "rising", "falling", "same_time", "sparse"])
def test_episodes_equal_sequential_fold(spark, shape):
    rng = np.random.default_rng(11)
    n = 1500
    span = {"same_time": 50, "sparse": 400_000}.get(shape, 20_000)
    rows = []
    for i in range(n):
        t = int(rng.integers(0, span))
        score = {"rising": t / span, "falling": -t / span}.get(shape, float(rng.integers(0, 300)) / 1000)
        rows.append((i, t, f"10.0.0.{rng.integers(0, 5)}", "hot" if rng.random() < 0.7 else "cold", score))
    df = spark.createDataFrame(rows, "id long, t long, src_ip string, type string, if_score double")
    df = df.withColumn("timestamp", F.timestamp_seconds("t"))
    got = {r["id"] for r in alerts.episodes(df, tie=("src_ip", "id")).select("id").collect()}
    assert got == fold(rows, 900)


def test_sample_is_the_same_on_any_partitioning(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    pick = lambda d: {r[0] for r in sampling.sample_n(d, 300, 1, "id").select("id").collect()}
    assert pick(df.repartition(3)) == pick(df.repartition(11)) and len(pick(df)) == 300


@pytest.mark.parametrize("n", [1, 700, 2999, 5000])
def test_pruned_sample_path(spark, monkeypatch, n):
    df = spark.range(3000)
    expect = {r[0] for r in sampling.sample_n(df, n, 9, "id").collect()}
    monkeypatch.setattr(ordered, "PLAIN_TOP_ROWS", 50)
    monkeypatch.setattr(ordered, "PRUNE_SAMPLE", 400)
    assert {r[0] for r in sampling.sample_n(df, n, 9, "id").collect()} == expect
    monkeypatch.setattr(ordered, "TOP_N_LIMIT", 10)
    assert {r[0] for r in sampling.sample_n(df, n, 9, "id").collect()} == expect and len(expect) == min(n, 3000)


def test_smallest_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PLAIN_TOP_ROWS", 50)
    monkeypatch.setattr(ordered, "PRUNE_SAMPLE", 300)
    df = spark.range(4000).withColumn("v", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.0))
    got = [r["id"] for r in ordered.smallest(df, ["v", "id"], 40).orderBy("v", "id").collect()]
    assert got == [3 * i for i in range(40)]


def test_split_without_shuffle_keeps_proportions(spark):
    df = spark.range(20_000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    split = sampling.stratified_split(df, [0.6, 0.2, 0.2], "y", "id", exact=False)
    share = {r["split"]: r["count"] / 20_000 for r in split.groupBy("split").count().collect()}
    assert share[0] == pytest.approx(0.6, abs=0.02) and share[2] == pytest.approx(0.2, abs=0.02)
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


def test_owned_intermediates_go(spark):
    import os

    from flowarden.session import materialise, owned_intermediates

    with owned_intermediates(spark) as path:
        stored = materialise(spark.range(5), "five")
        place = path.removeprefix("file:")
        assert stored.count() == 5 and os.listdir(place)
    assert not os.path.exists(place)


def test_shuffle_files_of_a_write_go_with_it(spark, tmp_path):
    from flowarden.session import FREE_SHUFFLES, shuffles_freed

    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for name in (str(f.getName()) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if name.startswith("shuffle_")}

    kept, df = files(), ordered.ranked_by_range(spark.range(5000), ["id"], ranges=4)
    kept |= files()
    with shuffles_freed(spark):
        df.write.parquet(f"{tmp_path}/ranked")
    assert files() <= kept and spark.conf.get(FREE_SHUFFLES) == "false"
    assert spark.read.parquet(f"{tmp_path}/ranked").count() == 5000


@pytest.mark.parametrize("skip, n", [(0, 5), (1500, 30), (4000, 7), (5990, 30), (7000, 3), (40, 0)])
def test_rows_between_positions(skewed, skip, n):
    df, rows = skewed
    got = [(r["v"], r["id"]) for r in ordered.between(df, ["v", "id"], skip, n, most_rows=100).collect()]
    assert got == sorted((v, i) for i, _, v in rows)[skip : skip + n]


@pytest.fixture
def records(spark):
    rows = [(i, None if i % 5 == 0 else "Offline" if i % 3 else "Online", i % 2, f"10.0.0.{i % 4}", "UDP", float(i % 7)) for i in range(1, 901)]
    return spark.createDataFrame(rows, "id long, mode string, prediction int, src_ip string, protocol string, confidence double").repartition(5)


@pytest.mark.parametrize("order", ["ASC", "DESC"])
@pytest.mark.parametrize("by", ["mode", "confidence"])
def test_deep_and_following_pages_are_those_of_the_whole_order(records, by, order):
    whole, plain_total = history.history_page(records, limit=10_000, sort_by=by, sort_order=order, plain_rows=20_000)
    want = [r["id"] for r in whole.collect()]
    for offset in (0, 170, 890, 950):
        page, total = history.history_page(records, limit=20, offset=offset, sort_by=by, sort_order=order, plain_rows=50)
        assert [r["id"] for r in page.collect()] == want[offset : offset + 20]
        assert total.first() == plain_total.first() == (900,)
    got, seen = [], None
    while page := history.history_page(records, limit=180, sort_by=by, sort_order=order, after=seen)[0].collect():
        got += [r["id"] for r in page]
        seen = (page[-1][by], page[-1]["id"])
    assert got == want


def test_batches_of_history_never_share_ids(spark, tmp_path):
    path = str(tmp_path / "history")
    df = spark.range(1, 41).selectExpr("id AS k", "'Online' AS mode", "'a' AS src_ip", "'b' AS dst_ip", "'TCP' AS protocol", "80 AS dst_port", "1 AS prediction", "0.5 AS confidence", "'x' AS attack_type", "-0.5 AS if_score", "0.5 AS xgb_prob")
    df = df.withColumn("contributions", F.array().cast(IMPACT_TYPE))
    for batch in (7, 3, 7):  # the last is a retry
        assert tables.append_history(df, path, "k", batch=batch).count() == 40
    ids = sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert ids == [*range((3 << 32) + 1, (3 << 32) + 41), *range((7 << 32) + 1, (7 << 32) + 41)]
    with pytest.raises(ValueError, match="out of range"):
        tables.append_history(df, path, "k", batch=0)
