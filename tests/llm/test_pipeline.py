"""The pipeline stage by stage against plain versions, on a small table of every odd case."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_pseudonyms import card, luhn
from tests.llm.test_simhash import classes, near, slow_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows of the given documents with odd ones among them, and of every stage after them."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, "12 !?", "fr", "src2", 5), (None, "words that have no id at all", None, None, 28),
           (9004, "the same text twice over", "en", None, 24), (9004, "the same text twice over", "en", None, 24), (9005, "a card 4012888888881881 of the house", None, "src3", 36), (9006, "the " * 30_000, "en", "src1", 120_000)]
    docs = given.unionByName(spark.createDataFrame(odd, given.schema))
    out, root = [docs.collect()], tmp_path_factory.mktemp("stages")
    for name, stage in C.STAGES:
        made = stage(spark, docs, sf_dir)
        if name != "packing":
            assert made.columns == given.columns
        made.write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs.collect())
    return out


def key(r):
    return (r.doc_id, r.text, r.source)


def test_language_stage(stages):
    before, after = stages[0], stages[1]
    assert Counter(map(key, after)) == Counter(key(r) for r in before if r.text and any(map(str.isalpha, r.text)))
    right = [r.lang == b.lang for r in after for b in before if b.doc_id == r.doc_id and b.lang and len(b.text) > 50]
    assert sum(right) / len(right) > 0.95


def test_dedup_stage(stages):
    before, after = sorted(stages[1], key=lambda r: (r.doc_id is None, r.doc_id)), stages[2]
    roots = classes([slow_fingerprint(r.text) for r in before], near)
    assert Counter(map(key, after)) == Counter(key(before[i]) for i in set(roots))


def test_personal_data_stage(stages):
    before, after = {r.doc_id: r for r in stages[2]}, {r.doc_id: r for r in stages[3]}
    assert before.keys() == after.keys()
    for i, r in after.items():
        for number in re.findall(r"(?<!\w)\d{16}(?!\w)", before[i].text):
            assert (card(number) in r.text) and (luhn(number) % 10 or number not in r.text)
        assert r.text == before[i].text or r.n_chars == len(r.text)
    assert after[9005].text == f"a card {card('4012888888881881')} of the house"


def test_mixing_stage(stages):
    size = Counter()
    for r in stages[3]:
        size[r.source] += len(r.text.split())
    copies, taken = Counter(map(key, stages[4])), Counter()
    for r in stages[4]:
        taken[r.source] += len(r.text.split())
    assert max(copies.values()) <= 3 and set(copies) <= set(map(key, stages[3]))
    assert all(taken[s] <= 3 * size[s] for s in size)


def test_packing_stage(stages):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    tokens = {r.doc_id: len(encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4]}
    copies = Counter(r.doc_id for r in stages[4])
    packed = Counter()
    for r in stages[5]:
        packed[r.doc_id] += r.length
    assert packed == {i: copies[i] * tokens[i] for i in copies}
    ends = {}
    for r in sorted(stages[5], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert np.max(list(ends.values())) <= 2048


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
