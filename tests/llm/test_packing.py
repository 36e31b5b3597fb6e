"""Ids against the tokenizer itself, exact coverage, patterns against bounds and a small optimum."""

import itertools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowarden.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)
ENCODER = P.Encoder(PATH)


def ids(text):
    return REAL.encode(text or "", add_special_tokens=False).ids


def of(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("aB'st 9.,\n\t\r é²\xa0\xad́日ĸ<|endoftext>")), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert of(ENCODER.encode(text)) == ids(text)


def test_whole_documents_and_special_tokens(sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() + [None, "", "a <|endoftext|> b", "x" * 40_000, "it's we'll \u2003 odd"]
    assert ENCODER.fast and all(of(ENCODER.encode(t)) == ids(t) for t in texts)


def test_other_tokenizers_are_used_as_they_are():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = P.Encoder(path)
    assert other.fast is None and of(other.encode("One two")) == Tokenizer.from_file(path).encode("One two", add_special_tokens=False).ids


def check(rows, docs):
    """Every id in one piece, sequences gapless within capacity."""
    want = sorted((-1 if i is None else i, *ids(t), 1) for i, t in docs)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(len(w) - 1 for w in want)
    tokens = {}
    for i, t in docs:
        tokens.setdefault(i, []).append(np.array([*ids(t), 1], "<u4"))
    for i, parts in by_doc.items():
        assert {zlib.crc32(t[r.start : r.start + r.length].tobytes()) for r in parts for t in tokens[i]} >= {r.ids_crc32 for r in parts}
        assert sum(r.length for r in parts) == sum(map(len, tokens[i])) and {r.doc_tokens for r in parts} == {len(t) for t in tokens[i]}
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY
    return by_sequence


def test_cases(spark):
    docs = [(1, "one"), (2, None), (3, ""), (None, "no id"), (4, "word " * 9000), (5, "the same"), (5, "the same"), (6, "é\t日")]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in docs], "doc_id long, text string, sequence_id int, length int, __kind int")
    check(P.pack_documents(df).collect(), docs)
    assert P.pack_documents(df.limit(0)).count() == 0
    kept = P.pack_documents(df, keep_ids=True).where("doc_id = 1").first()
    assert kept.ids == [*ids("one"), 1]


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    sequences = check(P.pack_documents(df).collect(), docs)
    total = sum(r.length for s in sequences.values() for r in s)
    assert len(sequences) * P.CAPACITY <= total * 1.02 + 2 * P.CAPACITY


def test_patterns_use_every_piece_near_the_bound():
    rng = np.random.default_rng(1)
    size = np.arange(1, 129)
    need = rng.integers(0, 400, 128) + 1
    patterns = P.solve_patterns(size, need, 128)
    assert sum(t * p for t, p in patterns).tolist() == need.tolist()
    assert all(p @ size <= 128 for _, p in patterns)
    bound = max(need @ size / 128, need[size > 64].sum())
    assert sum(t for t, _ in patterns) <= bound * 1.01 + 20


def test_knapsack_against_all_fillings():
    size, price = np.array([3, 4, 5]), np.array([4.0, 5.5, 6.9])
    best = max(sum(a * b for a, b in zip(c, price)) for c in itertools.product(range(5), repeat=3) if sum(a * b for a, b in zip(c, size)) <= 13)
    value, pattern = P._best_pattern(size, price, 13)
    assert abs(value - best) < 1e-9 and pattern @ size <= 13 and abs(pattern @ price - value) < 1e-9
