"""Fingerprints, the Gray-order index and duplicate classes against brute force."""

import numpy as np
import pytest
import xxhash

from flowarden.llm import simhash as S
from flowarden.llm.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    total = 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    for bit in range(64):
        total |= (2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit
    return total


def classes(items, linked):
    """Smallest reachable position for each item, pair by pair."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def near(a, b):
    return (a ^ b).bit_count() <= 3


def clustered(rng, n, spread):
    """Fingerprints around a few centres: alike enough to need every bound of the index."""
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    out = centres[rng.integers(0, 5, n)]
    for _ in range(spread):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(out)


def gray(fps):
    r = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return fps[np.argsort(r)]


@pytest.mark.parametrize("spread", [1, 2, 4, 7])
def test_index_in_a_task(spread):
    fps = gray(clustered(np.random.default_rng(spread), 400, spread))
    want = classes([int(x) for x in fps], near)
    assert S.link_block(fps, np.zeros(len(fps), int)).tolist() == want


def test_groups_are_apart():
    fps = np.array([1, 3, 1, 3], np.uint64)
    assert S.link_block(fps, np.array([0, 0, 1, 1])).tolist() == [0, 0, 2, 2]


@pytest.mark.parametrize("group_rows", [8192, 20])
def test_links_reach_every_class(spark, group_rows):
    fps = clustered(np.random.default_rng(3), 700, 4).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = dict(connected_components(S.near_links(df, 3, group_rows)).collect())
    want = classes([x & (2**64 - 1) for x in fps], near)
    groups = {}
    for x, w in zip(fps, want):
        groups.setdefault(w, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set.union(*groups.values()))


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (5, 4)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [
    (5, "One two three four five six"), (3, "one TWO three\tfour five six"), (9, None), (4, ""), (8, " \n "), (None, "one two three four five six"),
    (7, "É lone"), (6, "x " * 30_000), (6, "x " * 30_000), (11, "quite another text than the others here"), (None, "all alone without an id"), (None, "all alone without an id"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp long, component_id long")


def test_every_row_keeps_its_class(spark):
    got = S.near_duplicates(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    want = {"one": 3, "none": 4, "x": 6, "other": 11, "alone": None}
    prints = {k: f"{slow_fingerprint(t):016x}" for k, t in (("one", ROWS[0][1]), ("none", ""), ("x", ROWS[7][1]), ("other", ROWS[9][1]), ("alone", ROWS[10][1]))}
    for name, fp in prints.items():
        rows = [r for r in got if r.fingerprint == fp]
        assert rows and {r.component_id for r in rows} == {want[name]}
    assert S.near_duplicates(table(spark, [])).count() == 0


def test_one_row_of_each_class_stays(spark):
    kept = S.keep_one(table(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 6), (False, 7), (False, 11), (True, 0)]
    assert S.keep_one(table(spark, [])).count() == 0


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fps = [slow_fingerprint(d.text) for d in docs]
    want = classes(fps, near)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == {d.doc_id: (f"{f:016x}", docs[w].doc_id) for d, f, w in zip(docs, fps, want)}
