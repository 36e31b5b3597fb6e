"""Trigram bundles against a plain loop, undefined texts, held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from flowarden.llm import language as L
from flowarden.llm.queries import QUERIES


def slow_letter(symbol):
    out = []
    for word in range(L.DIMENSIONS // 64):
        z = (symbol * (L.DIMENSIONS // 64) + word + (L.SEED << 32)) * 0x9E3779B97F4A7C15 % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        z ^= z >> 31
        out += [2 * (z >> i & 1) - 1 for i in range(64)]
    return np.array(out)


def slow_bundle(text):
    symbols = [0]
    for c in text.lower():
        s = ord(c) - 96 if "a" <= c <= "z" else L.PLAIN + ord(c) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    symbols += [0] if symbols[-1] else []
    total = np.zeros(L.DIMENSIONS, int)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        total += np.roll(slow_letter(a), 2) * np.roll(slow_letter(b), 1) * slow_letter(c)
    return total


def bundled(text):
    return L.bundle(*np.unique(L.trigrams(text), return_counts=True))


def test_bundle_is_the_sum_of_bound_letters():
    for text in ("Ça va, 123 the  THE öß x", "абв гд 漢字かな 𐐷 a", "plain words only"):
        assert bundled(text).tolist() == slow_bundle(text).tolist()
    assert len(L.trigrams("12 --")) == 0 and len(L.trigrams("a")) == 1
    many = "".join(chr(0x4E00 + i * 7 % 9000) for i in range(9000))  # more trigrams than are bound at once
    assert len(np.unique(L.trigrams(many))) > 2 * L.AT_ONCE
    assert (bundled(many) == L.bind(L.trigrams(many)).sum(0, dtype=int)).all()


def test_letters_of_any_script_have_their_own_vectors():
    vectors = L.letter_vectors(L._symbol_table()[[ord(c) for c in "abzéàабвгдαβγ漢字かな"]])
    near = vectors.astype(int) @ vectors.T.astype(int)
    assert (np.abs(near - L.DIMENSIONS * np.eye(len(vectors), dtype=int)) < L.DIMENSIONS // 5).all()


def test_languages_of_one_other_script_are_told_apart(spark):
    said = {"ru": "это был первый день когда они пошли в город", "bg": "това беше първият ден когато те отидоха в града", "uk": "це був перший день коли вони пішли до міста", "el": "ήταν η πρώτη μέρα που πήγαν στην πόλη"}
    model = L.learn(spark.createDataFrame([(t, k) for k, t in said.items()], "text string, lang string"))
    asked = {"ru": "они пошли в первый город", "bg": "те отидоха първият ден", "uk": "вони пішли перший день", "el": "πήγαν στην πρώτη πόλη"}
    rows = spark.createDataFrame(list(asked.items()), "lang string, text string").select("lang", L.identify("text", model).alias("p")).collect()
    assert all(r.lang == r.p.lang_pred for r in rows)


def test_undefined_texts_and_empty_model(spark):
    rows = [(1, "the of and the", "en"), (2, "le la les des", "fr"), (3, None, "en"), (4, "", None), (5, "12 !?", "fr"), (6, "the of " * 60_000, None), (6, "the of", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert list(model) == ["en", "fr"]
    got = [(r.doc_id, r.p.lang_pred) for r in docs.select("doc_id", L.identify("text", model).alias("p")).collect()]
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert L.learn(docs.limit(0)) == {}
    assert {r.p.lang_pred for r in docs.select(L.identify("text", {}).alias("p")).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_model_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 500)
    a, b = L.learn(docs.coalesce(1)), L.learn(docs.repartition(7))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)
