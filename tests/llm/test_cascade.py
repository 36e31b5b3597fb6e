"""Base figures against plain loops, verdicts independent of the order, order by rejections per cost."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowarden.llm import cascade as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "\n", "é#", " x", "\x85", "a b a b a b a b a b", "\x1cq", "日|"]), max_size=60))
def test_figures(parts):
    text = " ".join(parts)
    t = Q.Text(text)
    assert (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed) == slow(text)


TEXTS = [None, "", " \n", "too few words", "word " * 30, " ".join(f"w{i}" for i in range(30)), " ".join(f"W{i}Q" for i in range(30)),
         " ".join(f"{i}" for i in range(40)), "\n".join(f"- item {i} of the list ..." for i in range(20)), " ".join(f"w{i}#*" for i in range(30)),
         "\n".join(["same line"] * 4 + [f"line {i} is quite its own" for i in range(6)]), " ".join(f"long{i}" for i in range(30_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, 7, True) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 7, True)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")


def test_every_row_and_any_order(docs):
    got = Q.quality(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[r.doc_id or 0]
        if len(text or "") < 10_000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(text)
        t = Q.Text(text)
        assert r.kept == (not t.base_failed and not any(rule(t) for rule in Q.RULES))
        assert (r.rejected_by is None) == r.kept
    plain = [(r[0], r.q.kept) for r in docs.select("doc_id", Q.assess("text", Q.RULES[::-1]).alias("q")).collect()]
    assert sorted(plain, key=str) == sorted(((r.doc_id, r.kept) for r in got), key=str)
    assert Q.quality(docs.limit(0)).count() == 0


def test_measured_shares(docs):
    got = Q.measure(docs)
    assert got["upper_case"][1] > 0 and all(s >= 0 for s, _ in got.values())


def test_sample_holds_neither_all_null_ids_nor_rows_of_the_base_rule(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(t):
        seen.add(1)
        return "x" in t.words

    good, bad = " ".join(f"w{i}" for i in range(30)), "too few"
    rows = spark.range(40_000).selectExpr(f"IF(id % 2 = 0, '{good}', '{bad}') AS text", "CAST(NULL AS LONG) AS doc_id")
    assert Q.measure(rows, (watch,), sample_rows=1000)["watch"][1] == 0
    assert 300 < seen.value < 700


def test_order_by_rejections_per_cost():
    measured = {r.__name__: (1.0, 0.0) for r in Q.RULES}
    measured |= {"bullets": (0.5, 0.1), "symbols": (0.1, 0.05), "one_word": (0.2, 0.0)}
    order = [r.__name__ for r in Q.ordered_rules(measured)]
    assert order[:3] == ["symbols", "bullets", "one_word"]
