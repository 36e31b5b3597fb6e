"""Hosts, rules and exact membership against plain code, in one slice and in several."""

import pytest
from pyspark.sql import functions as F

from flowarden.llm import urlfilter as U

URLS = ["http://Example.ORG/es/x?y", "https://www.example.org/en/12", "https://example.org/en/2", "https://badexample.org/es/", "http://a.com/fr/1#x", "http://a.com/de/",
        "http://com/de/1", "http://A.b.Cheap-Pills.example.net:80/p/q", "http://cheap-pills.example.net", "ftp://example.org", "http://x.net?://org/", "://org/", "no scheme", "", None,
        "http://", "http:///es/", "http://org/", "http://É.org/", "http://notcheap-pills.example.net/", "http://a.net/" + "x" * 50_000, "http://two\nlines.net/a\nb?c", "http://www.x.example.org/es/", "http://a..b./z"]


def slow(url, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    labels = host.split(".")
    hit = any(".".join(labels[i:]) in listed for i in range(len(labels))) and host != ""
    rule = max(fit)[1:] if fit else (None, None)
    return host, path, rule[0], rule[1] or ("block" if hit else "allow")


@pytest.mark.parametrize("most_bits", [U.MOST_BITS, 40])
def test_every_url(spark, most_bits):
    listed = {"cheap-pills.example.net", "a.net", "x.net", "unseen.host"}
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*URLS, URLS[0], None])], "page_id int, url string, host string")
    keys = spark.createDataFrame([(k,) for k in [*listed, "A.net", None]], "key string")
    got = U.judge(pages, keys, most_bits=most_bits).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [slow(u, listed) for u in [*URLS, URLS[0], None]]


def test_membership_is_exact_where_filters_are_not(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS_PER_KEY", 1)
    monkeypatch.setattr(U, "CHUNK", 32_768)
    universe = spark.range(120_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = U.cascade(universe)
    assert len(levels) > 2
    assert universe.where(U.is_listed(F.col("key"), levels) != F.col("listed")).count() == 0


def test_nothing_listed_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id int, url string")
    none = spark.createDataFrame([], "key string")
    assert U.judge(pages, none).first().verdict == "allow"
    assert U.judge(pages.limit(0), none).count() == 0
    assert [r.key for r in U.listed_domains(spark.createDataFrame([("http://x.adult-x.a.b/",), (None,)], "url string")).collect()] == ["adult-x.a.b"]
