"""The trie of conversation prefixes against plain Python and DuckDB."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from checks.compare import differences, duck
from flowarden.llm import convtrie as T
from flowarden.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        path = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def dialogues(rng, n, length, words="ab"):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words) * rng.randrange(1, 3)) for c in range(n) for t in range(rng.randrange(length))]


@pytest.mark.parametrize("batches", [(), (1 / 16, 1 / 4), (0.2, 0.4, 0.6, 0.8)])
def test_random_conversations(spark, monkeypatch, batches):
    monkeypatch.setattr(T, "BATCHES", batches)
    rng = random.Random(len(batches))
    rows = dialogues(rng, 150, 12) + [(c + 200, t, r, x) for c, t, r, x in dialogues(rng, 40, 40, "a")]
    rng.shuffle(rows)
    assert got(T.prefix_trie(table(spark, rows))) == slow_trie(rows)


def test_odd_conversations(spark):
    rows = [
        (None, 1, "user", "nobody's"), (7, None, None, None), (7, None, None, None), (7, 3, "user", "é🙂"), (-205, 1, "user", "below zero"), (-205, 2, "user", "x" * 100_000),
        (300, 1, "user", "base"), (301, 5, "", ""), (302, 5, None, ""), (303, 2, "b", "tie"), (303, 2, "a", "tie"), (303, 2, "a", "Tie"), (5_000_000_000, 1, "user", "far"),
        *[(304, i, "user", f"turn {i}") for i in range(300)], *[(305, i, "user", f"turn {i}") for i in range(257)],
    ]
    assert got(T.prefix_trie(table(spark, rows))) == slow_trie(rows)


def test_turnless_conversations(spark):
    empty = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 >= 1]
    rows = [(c, 0, "user", "only its first turn, which the absent conversation 0 replaces") for c in empty]
    made = got(T.prefix_trie(table(spark, rows)))
    assert made == slow_trie(rows) and len(made) == 1 and made[0][3:6] == (len(empty), 0, 1)
    assert got(T.prefix_trie(table(spark, []))) == []


def test_crowded_nodes(spark, monkeypatch):
    monkeypatch.setattr(T, "LISTED_IDS", 20)
    monkeypatch.setattr(T, "BLOCK_IDS", 7)
    rows = [(c, t, "user", "the same") for c in range(-50, 1500) for t in range(6)]
    rows += [(c, t, "user", f"{c % 3}{t}") for c in range(2000, 2200) for t in range(7)]
    assert got(T.prefix_trie(table(spark, rows))) == slow_trie(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a int, b int")
    from pyspark.sql import functions as F

    for r in df.select("a", "b", T.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_query_against_sql(spark, sf_dir):
    name = "op12_conversation_trie"
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(SQL[name]).df()) is None
