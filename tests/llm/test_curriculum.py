"""Targets against a plain loop, near-exact shares, whole copies in schedule order."""

import pytest
from pyspark.sql import functions as F

from flowarden.llm import curriculum as C


def slow_targets(sizes):
    """``sizes``: source to size, in order. Cap and share again until none is above."""
    names = list(sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, target = sum(sizes.values()), {}
    while True:
        open_ = [n for n in names if n not in target]
        if not open_:
            return target
        share = (total - sum(target.values())) / sum(weight[n] for n in open_)
        over = [n for n in open_ if weight[n] * share > 3 * sizes[n]]
        if not over:
            return target | {n: weight[n] * share for n in open_}
        target |= {n: 3 * sizes[n] for n in over}


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, position int")


@pytest.fixture(scope="module")
def rows():
    sizes = {"Z": 30, "a": 5, "b": 900, "é": 60, "日": 1, None: 40}
    made = [(100 * i + j, "w " * (1 + j % 7), s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return made + [(7001, None, "a"), (7002, " \n ", "b"), (7003, "x " * 20_000, "b"), (None, "no id", "a"), (5, "twice it is", None), (5, "twice it is", None)]


def test_targets_and_taken(spark, rows):
    got = C.plan(docs(spark, rows), ["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    sizes = {}
    for s in sorted({r[2] for r in rows}, key=lambda s: (s is None, s or "")):
        sizes[s] = sum(len((r[1] or "").split()) for r in rows if r[2] == s)
    want = slow_targets(sizes)
    longest = {s: max(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sizes}
    for s in sizes:
        own = [r for r in got if r["__1"] == s]
        assert {r.source_size for r in own} == {sizes[s]} and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= longest[s]
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in got)


def test_same_on_any_partitioning(spark, rows, monkeypatch):
    df = docs(spark, rows)
    first = sorted(map(str, C.plan(df.coalesce(1), ["doc_id", "source"]).collect()))
    monkeypatch.setattr(C, "LEAST_SLICES", 3)
    assert sorted(map(str, C.plan(df.repartition(9), ["doc_id", "source"]).collect())) == first


def test_mix_is_sorted_and_whole(spark, rows):
    df = docs(spark, rows)
    mixed = C.mix(df)
    assert mixed.columns == df.columns
    planned = {}
    for r in C.plan(df, ["doc_id", "source"]).collect():
        planned[r["__0"], r["__1"]] = planned.get((r["__0"], r["__1"]), 0) + r.passes
    got = {}
    for r in mixed.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: v for k, v in planned.items() if v}
    assert C.mix(df.limit(0)).count() == 0 and C.plan(df.limit(0), ["doc_id"]).count() == 0


def test_time_inverts_the_integrated_schedule(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("t")).crossJoin(spark.createDataFrame([(x,) for x in (0.4, 1.0, 1.6)], "tilt double"))
    asked = F.col("tilt") * F.col("t") - (F.col("tilt") - 1) * F.col("t") * F.col("t")
    worst = df.select(F.max(F.abs(C.training_time(asked, F.col("tilt")) - F.col("t")))).first()[0]
    assert worst < 1e-6


def test_front_loaded_sources_come_earlier(spark, rows):
    placed = C.positions(C.plan(docs(spark, rows), ["doc_id"])).groupBy("rank").agg(F.avg("position").alias("p")).collect()
    mean = {r["rank"]: r["p"] for r in placed}
    assert mean[0] < mean[1] < mean[2]


def test_spans_are_first_and_last_copies(spark, rows):
    planned = C.plan(docs(spark, rows), ["doc_id"])
    copies = C.positions(planned).groupBy("__0", "begins", "rank").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("copy").alias("n"))
    want = sorted((r["__0"] or 0, r.rank, r.begins, r.n, r.a, r.b) for r in copies.collect())
    spans = C.spans(planned).collect()
    assert sorted((r["__0"] or 0, r.rank, r.begins, r.passes, r.first_position, r.last_position) for r in spans if r.passes) == want
    assert len(spans) == planned.count() and all(r.first_position is None and r.last_position is None for r in spans if not r.passes)
