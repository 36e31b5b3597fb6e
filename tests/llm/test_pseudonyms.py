"""Pseudonyms against a plain implementation; formats, links, decoys and odd texts."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from flowarden.llm import pseudonyms as P
from flowarden.llm.queries import QUERIES


def h(tag, *parts):
    return int(hashlib.sha256("|".join([P.KEY, tag, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(left, right, a, b, tag):
    for i in range(8):
        if i % 2 == 0:
            left = (left + h(tag, i, right)) % a
        else:
            right = (right + h(tag, i, left)) % b
    return left, right


def digits(d, kind):
    a = len(d) // 2
    left, right = feistel(int(d[:a] or 0), int(d[a:]), 10**a, 10 ** (len(d) - a), f"{kind}{len(d)}")
    return (str(left).zfill(a) if a else "") + str(right).zfill(len(d) - a)


def luhn(d, shift=0):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if (i + shift) % 2 else int(c) for i, c in enumerate(reversed(d)))


def card(m):
    d = re.sub(r"\D", "", m)
    if luhn(d) % 10:
        return m
    new = digits(d[:-1], "card")
    new += str(-luhn(new, 1) % 10)
    it = iter(new)
    return re.sub(r"\d", lambda _: next(it), m)


def ip(m):
    p = list(map(int, m.split(".")))
    if max(p) > 255:
        return m
    left, right = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, found string")
    rows = P.pseudonymise(df, found_as="kinds").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.kinds for r in rows]


CARD, IBAN = "4012888888881881", "DE89 3704 0044 0532 0130 00"


def test_numbers_against_plain_code(spark):
    values = [CARD, "4012-8888-8888-1881", "378282246310005", "83.229.25.121"]
    got, kinds = run(spark, values + [f"a {v} b, {v}." for v in values])
    want = [card(v) for v in values[:3]] + [ip(values[3])]
    assert got[:4] == want and got[4:] == [f"a {w} b, {w}." for w in want]
    assert kinds[4:] == [["card"] * 2] * 3 + [["ip"] * 2]
    assert all(luhn(re.sub(r"\D", "", w)) % 10 == 0 for w in want[:3])


def test_invalid_values_and_clean_texts_stay(spark):
    texts = ["4012888888881882", "999.1.2.3", "1.2.3.4.5", "2023-02-30 and 31/31/2020", "000-12-3456 666-12-3456", "DE88370400440532013000", "version 2.0, 12345", "at @ home", "x4012888888881881", "", None, "plain words only"]
    got, kinds = run(spark, texts)
    assert got == texts and all(k == [] for k in kinds)


def test_formats_and_links(spark):
    text = f'{IBAN}; mail an.08@mail1.example.com, über.7@x.org or AN.08@mail1.example.com tel +1 (407) 555-7710 (407) 555-7710 ssn 123-45-6789 born 1980-02-29, 29/02/1980, 29.2.1980 2353820953013749 {CARD} token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" end'
    (a, b), (kinds, _) = run(spark, [text, text + " again"])
    assert b == a + " again"
    assert kinds == ["iban", "email", "email", "email", "phone", "phone", "ssn", "date", "date", "date", "card", "secret"]
    for gone in (IBAN, "an.08@", "AN.08@", "über", "(407) 555-7710", "123-45-6789", "1980-02-29", "29.2.1980", CARD, "9b0b3c6a"):
        assert gone not in a
    assert "2353820953013749" in a and 'token = "' in a and re.search(r'"[0-9a-f]{40}" end$', a)
    mails = re.findall(r"p\d{19}@person\.example", a)
    assert len(mails) == 3 and mails[0] == mails[2] != mails[1]
    iso = re.search(r"born (\d{4})-(\d\d)-(\d\d), (\d\d)/(\d\d)/(\d{4}), (\d+)\.(\d+)\.(\d{4})", a).groups()
    assert datetime.date(*map(int, iso[:3])) == datetime.date(*map(int, iso[5:2:-1])) == datetime.date(*map(int, iso[8:5:-1]))
    assert re.search(r"tel \+1 \(\d{3}\) \d{3}-\d{4} \(\d{3}\) \d{3}-\d{4} ssn \d{3}-\d\d-\d{4} ", a)
    account = a.split(";")[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1 and re.match(r"DE\d\d( \d{4}){4} \d\d;", a)


def test_days_are_permuted(spark):
    days = spark.range(P.DAYS).select(P.permute_day(F.col("id"), P.KEY).alias("d"))
    row = days.agg(F.countDistinct("d").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    assert tuple(row) == (P.DAYS, 0, P.DAYS - 1)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_digits_are_permuted(spark, width):
    rows = spark.range(10**width).select(F.lpad(F.col("id").cast("string"), width, "0").alias("d"))
    got = rows.select("d", P.permute_digits(F.col("d"), P.KEY, "t").alias("p")).collect()
    assert len({r.p for r in got}) == 10**width and all(r.p == digits(r.d, "t") for r in got[:50])


def test_long_and_repeated_rows(spark):
    long = ("word " * 20_000) + CARD + (" a1" * 20_000) + "b" * 50_000 + "@"
    got, kinds = run(spark, [long, long])
    assert got[0] == got[1] == long.replace(CARD, card(CARD)) and kinds == [["card"]] * 2
    df = spark.createDataFrame([], "text string")
    assert P.pseudonymise(df).count() == 0


def test_documents(spark, sf_dir):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_pii_pseudonyms"](spark, sf_dir).collect()
    assert len(rows) == len(before)
    for r in rows:
        old = before[r.doc_id]
        cards = [m for m in re.findall(r"(?<!\w)\d{16}(?!\w)", old) if luhn(m) % 10 == 0]
        assert not any(m in r.text for m in cards) and "@mail" not in r.text
        assert r.n_replaced or r.text == old
        assert all(m in r.text for m in re.findall(r"(?<!\w)\d{16}(?!\w)", old) if luhn(m) % 10)
    assert sum(r.n_replaced for r in rows) > 5


def phone(code, rest):
    it = iter(digits(re.sub(r"\D", "", rest), "phone"))
    return code + re.sub(r"\d", lambda _: next(it), rest)


PHONES = [
    ("+1", "4155550123"), ("+49", " 30 1234567"), ("+1", " 415 5550123"), ("", "415 555 0123"), ("+44", " (0) 20 7946 0958"), ("+1", " (407) 555-7710"),
    ("+353", "12345678"), ("+1", "(415)5550123"), ("+4", " 123 456 7890"), ("+7", "9161234567"), ("", "(407) 555-7710"), ("+49", "-30-1234567"), ("", "415.555.0123"),
]


def test_telephone_forms_against_plain_code(spark):
    values, want = ["".join(p) for p in PHONES], [phone(*p) for p in PHONES]
    texts = values + [f"(call {v}) 2024, or {v}." for v in values]
    got, kinds = run(spark, texts)
    assert got == want + [f"(call {w}) 2024, or {w}." for w in want]
    assert kinds == [["phone"]] * len(values) + [["phone"] * 2] * len(values)
    # a number is one, however it is written
    same, _ = run(spark, ["+14155550123", "+1 (415) 555-0123", "+1 415 5550123", f"+14155550123 {CARD}"])
    assert len({re.sub(r"\D", "", x) for x in same[:3]}) == 1 and same[3] == f"{same[0]} {card(CARD)}"
    stay = ["+1234567", "+1234567890123456", "1 415 55", "+1 2 3 4 5 6 7 8 9", "4155550123"]
    assert run(spark, stay)[0] == stay


def test_dates_with_the_year_first_and_slashes(spark):
    got, kinds = run(spark, ["born 2001/03/05.", "2001-03-05", "2001/3/5", "2001/02/30"])
    assert kinds == [["date"]] * 3 + [[]] and got[3] == "2001/02/30"
    parts = [list(map(int, re.findall(r"\d+", x))) for x in got[:3]]
    assert parts[0] == parts[1] == parts[2] != [2001, 3, 5]
    assert re.fullmatch(r"born \d{4}/\d\d/\d\d\.", got[0]) and got[2] == "{}/{}/{}".format(*parts[2])
