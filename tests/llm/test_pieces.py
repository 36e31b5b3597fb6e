"""Prefix-table encoding and decoding against the library itself."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from flowarden.llm import pieces
from flowarden.llm.queries import QUERIES

PATH = public_tokenizers.path(pieces.MODEL)
library = SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", " ", "  ", "▁", "▁▁", "\n", "\0", "é", "中", "🙂", "xxxxx", "ing", " the", "<s>", "</s>", "<0x41>", "1", "٣", "ﬁ", "벨", "�", "é", "İ"]


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable(PATH)


def ids(table, text):
    return array("i", table.encode(text)).tolist()


def test_odd_texts(table):
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        assert ids(table, text) == library.encode(text)


def test_texts_of_neighbouring_pieces(table):
    rng = random.Random(8)
    names = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    for _ in range(20_000):
        text = "".join(rng.choice(names) for _ in range(rng.randrange(1, 5))).replace("▁", rng.choice(["▁", " ", ""]))
        assert ids(table, text) == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text_comes_back(text):
    t = pieces.piece_table(None)
    made = ids(t, text)
    assert made == library.encode(text)
    assert t.decode(made) == library.decode(made) == text.replace("▁", " ")


def test_any_ids(table):
    rng = random.Random(9)
    for _ in range(20_000):
        some = [rng.choice([rng.randrange(259), rng.randrange(32_000), 259, 29871, 0, 1, 2]) for _ in range(rng.randrange(8))]
        assert table.decode(some) == library.decode(some)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 50_000, "ab" * 50_000, "中" * 5000, "\n" * 5000, "wordswithoutanyspace" * 10_000])
def test_long_texts(table, text):
    made = ids(table, text)
    assert made == library.encode(text) and table.decode(made) == text


def test_bounded_tables_change_nothing(table, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PIECES", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 3)
    monkeypatch.setattr(pieces, "KEPT_HEADS", 1)
    small = pieces.PieceTable(PATH)
    text = "several words, several of them several times: several words"
    assert ids(small, text) == library.encode(text) and len(small) <= 3 and len(small.older) <= 3 and len(small.pairs) <= 3


def test_columns(spark):
    rows = [(1, "one text"), (2, ""), (None, None), (4, "x " * 70_000), (4, "x " * 70_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    made = df.select("doc_id", "text", pieces.encode("text").alias("made"), pieces.encode("text", end=False).alias("open"))
    got = made.withColumn("back", pieces.decode("made")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "")
        assert r.made == [*want, library.eos_id()] and r.open == want and r.back == (r.text or "")
    assert df.limit(0).select(pieces.encode("text").alias("m")).select(pieces.decode("m")).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([None, 262],)], "ids array<int>")
    assert [r.t for r in odd.select(pieces.decode("ids").alias("t")).collect()] == [None, "", library.decode([262])]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {}
    for d in docs:
        made = [*library.encode(d.text or ""), library.eos_id()]
        want[d.doc_id] = (len(made), sha(" ".join(map(str, made))), sha(library.decode(made)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_sentencepiece_table"](spark, sf_dir).collect()}
    assert got == want
