"""Spelling variants against plain Python and DuckDB."""

import random
import re
import zlib
from collections import Counter

import pytest

from checks.compare import differences, duck
from flowarden.llm import variants as V
from flowarden.llm.queries import QUERIES, SQL


def slow_words(rows, least_chars=6, least_count=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(V.UPPER, V.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_chars:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_groups(words):
    out = {}
    for w, n in words.items():
        near = sorted(((-words[x], x) for x in words if one_edit(w, x)))
        form = near[0] if near and -near[0][0] >= 5 * n else None
        out[w] = [form and form[1], None, n, len(near), form and -form[0]]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: tuple(r) for w, r in out.items()}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("parts", [4, 7, 9])
def test_signatures_miss_nothing(parts):
    rng = random.Random(parts)
    for _ in range(3000):
        a = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 12)))
        at, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:at] + rng.choice("abcdefÿ") + a[at + (kind != 1) :] if kind < 2 else a[:at] + a[at + 1 :]
        if a == b or not b:
            continue
        mine, theirs = (V.signatures_of(x, {"e": 1, "a": 0}, parts) for x in sorted((a, b), key=len))
        roles = {(V.SAME, V.SAME)} if len(a) == len(b) else {(V.SHORTER, V.LONGER)}
        assert any(s == t and (r, q) in roles for r, s in mine for q, t in theirs)


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    words = {}
    while len(words) < 250:
        w = "".join(rng.choice("aben") for _ in range(rng.randrange(5, 8)))
        words[w] = rng.choice([5, 5, 6, 30, 31, 31, 200, 1200])
    words |= {"x" * 50_000: 5, "x" * 50_001: 30, "éléphant": 40, "elephant": 8, "éléphants": 8}
    made = V.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), parts=5)
    assert got(made) == slow_groups(words)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_chain_of_forms(spark):
    chain = [("a" * 6 + "b" * i, 5 * 5**i) for i in range(12)]
    ends = {r.root for r in V.group_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert ends == {chain[-1][0]}


def test_words_of_odd_tables(spark):
    rng = random.Random(3)
    syllables = ["ver", "Ein", "heit", "É", "ü", "ß", "×", "tion", "ou", "A"]
    rows = [(rng.choice([None, 7, -3, 12, 5_000_000_000]), "".join(rng.choice(syllables + [" ", "\n", "3"]) for _ in range(rng.randrange(4000)))) for _ in range(60)]
    rows += [(1, None), (2, ""), (None, None), (4, "12 !?"), rows[0], rows[0], (9, "Lettered " * 50_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    words = V.counted_words(df)
    want = slow_words(rows)
    assert {r.word: r.n for r in words.collect()} == want and want["lettered"] >= 49_999
    assert got(V.variants(df)) == slow_groups(want)
    assert V.variants(df.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    name = "op11_spelling_variants"
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(SQL[name]).df()) is None
