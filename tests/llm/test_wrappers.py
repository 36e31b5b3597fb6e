"""Parsing, alignment and templates on hand-made pages; the given pages against what they were made of."""

import html
import itertools
import re

from flowarden.llm import wrappers as W
from flowarden.llm.queries import QUERIES

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><h1>{h}</h1>{p}<div class="x-share">Share</div><form><p>Mail</p></form></article>'
    '<section class="comments"><p>nice</p></section><aside><p>side</p></aside><footer>&copy; me</footer></body></html>'
)


def test_the_article_alone():
    text = W.extract(PAGE.format(h="A &amp; B\n c", p="<p>one <i>tw</i>o<br>three<p><b>four  &lt;x&gt;<p>5 < 6 &eacute;&nbsp;x</p><ul><li>a<li>b</ul>"))
    assert text == "A & B c\none two\nthree\nfour <x>\n5 < 6 é x\na\nb"


def test_odd_pages():
    assert [W.extract(x) for x in (None, "", "<", "plain &amp; text", "<p", "<article>", "<script>x", "<!-- open", "<div>a</span></div>b")] == [
        "", "", "<", "plain & text", "", "", "", "", "a\nb"]
    assert W.extract("<main><p>m</p></main><p>out</p>") == "m"
    assert W.extract("<article><p>a</p></article><div class='comment-list'><article class='comment'>c</article></div><article>b</article>") == "a\nb"
    assert W.extract("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert len(W.extract("<article><p>" + "word " * 200_000)) == 999_999
    assert W.extract('<article><p title="a>b">x</p><p class=ad>y</p></article>') == "x"


def every_matching(one, two):
    """Size of the best matching by trying everything."""
    k1, k2 = W._children(one), W._children(two)

    def size(a, b):
        if one[a][0] != two[b][0]:
            return 0
        best = 0
        for n in range(min(len(k1[a]), len(k2[b])) + 1):
            for x in itertools.combinations(k1[a], n):
                for y in itertools.combinations(k2[b], n):
                    parts = [size(i, j) for i, j in zip(x, y)]
                    best = max(best, sum(parts)) if all(parts) or not n else best
        return best + 1

    return size(0, 0)


def test_alignment_is_the_largest():
    one = [["r", 0, 0], ["a", 1, 0], ["x", 2, 0], ["y", 2, 0], ["b", 1, 0], ["a", 1, 0], ["y", 2, 0]]
    two = [["r", 0, 0], ["b", 1, 0], ["a", 1, 0], ["y", 2, 0], ["x", 2, 0], ["c", 1, 0], ["a", 1, 0], ["x", 2, 0], ["y", 2, 0]]
    got = W.align(one, two)
    assert len(got) == every_matching(one, two)
    assert all(one[a][0] == two[b][0] for b, a in got.items())
    assert W.align([["r", 0, 0]], [["q", 0, 0]]) == {}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, "host") for i, u, h in rows], "page_id int, url string, html string, n_chars int, host string")


def test_constant_nodes_are_template(spark):
    body = "<body><div class=top>Site slogan</div><div class=story><p>{0} one</p><p>{0} two</p><span>Read on</span></div></body>"
    rows = [(i, f"http://a.net/{i}", body.format(f"text {i}")) for i in range(4)]
    rows += [(10 + i, f"http://b.net/{i}", body.format("same")) for i in range(5)]  # copies of one article
    rows += [(20, "http://c.net/", body.format("alone")), (21, None, body.format("no host")), (22, "http://a.net/n", None), (3, "http://a.net/3", body.format("text 3"))]
    got = sorted((r.page_id, r.text, r.n_chars) for r in W.main_texts(pages(spark, rows)).collect())
    whole = "Site slogan\n{0} one\n{0} two\nRead on"
    want = [(i, f"text {i} one\ntext {i} two") for i in (0, 1, 2, 3, 3)] + [(10 + i, whole.format("same")) for i in range(5)]
    want += [(20, whole.format("alone")), (21, whole.format("no host")), (22, "")]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert W.main_texts(pages(spark, rows)).columns == ["page_id", "url", "html", "n_chars", "host", "text"]
    assert W.main_texts(pages(spark, [])).count() == 0


def test_given_pages(spark, sf_dir):
    got = {r.page_id: r for r in QUERIES["op2_html_wrappers"](spark, sf_dir).collect()}
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(raw)
    for r in raw:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        text = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)
