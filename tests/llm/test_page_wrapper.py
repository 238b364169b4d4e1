import html
import json
import random
import re

import pytest

from qcorpus.llm import page_wrapper as P
from tests.conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string, text string, rule string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def blog(rng, k):
    body = [words(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f"<li><a href='/{k}{i}'>Menu {i}</a></li>" for i in range(rng.randint(2, 6)))
    paragraphs = "".join(rng.choice(["<p>{}</p>", "<p><b>{}<br>", "<P class='x{1}'>{0}"]).format(html.escape(b) + " &amp; &eacute;", k) for b in body)
    page = (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>"
            f"<header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><div class='ad banner'>Buy {k}</div>"
            f"<article><h1>T {k}</h1>{paragraphs}<form><input>Send</form><aside>Side {k}</aside></article>"
            f"<div id=comments><p>Reader {words(rng, 40)}</p></div><footer>&copy; foot</footer></body>")
    return page, "\n".join([f"T {k}", *[b + " & é" for b in body]])


def plain(rng, k):
    """No article element: the varying block is found by the wrapper."""
    body = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
    side = "<div class='box'><p>About this site and its makers, the same on all pages of it.</p></div>"
    page = (f"<html><body><div class='top'>Our site</div>{side}<div class='text'><h2>Head {k}</h2>"
            + "".join(f"<p>{b}</p>" for b in body) + "</div><ul class='links'>"
            + "".join(f"<li><a href='#'>{words(rng, 4)}</a></li>" for _ in range(rng.randint(3, 9))) + "</ul></body></html>")
    return page, "\n".join([f"Head {k}", *body])


@pytest.mark.parametrize("make", [blog, plain])
def test_templates(spark, make):
    rng = random.Random(4)
    pages = [make(rng, k) for k in range(40)]
    df = spark.createDataFrame([(k, f"http://{'ab'[k % 2]}.example.com/{k}", p, "old", "r") for k, (p, _) in enumerate(pages)],
                               SCHEMA).repartition(4)
    out = P.extract_pages(df)
    assert out.columns == ["page_id", "url", "html", "rule", "text", "n_chars"]
    for r in out.collect():
        assert r["text"] == pages[r["page_id"]][1] and r["n_chars"] == len(r["text"])


def test_given_pages(spark):
    df = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    for r in P.extract_pages(df).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article.replace("<b>", ""))]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_hard_pages(spark):
    pages = [None, "", "   ", "just text & more", "<p>unclosed <b>bold<p>next", "<<<>>> </p></div><article", "<article></article>",
             "<div>" * 3000 + "deep" + "</div>" * 3000, "<article>" + "<p>x y</p>" * 20000 + "</article>",
             "<script>no", "<!-- no", "a<br>b", "<article>one\n two&nbsp;three<br>four</article>", "<p hidden>no</p>yes"]
    want = ["", "", "", "just text & more", "unclosed bold\nnext", None, "", "deep", "\n".join(["x y"] * 20000), "", "", "a\nb",
            "one two three\nfour", "yes"]
    urls = [None, "", "not a url", "http://[broken"]
    df = spark.createDataFrame([(k, urls[k % 4], p, None, None) for k, p in enumerate(pages)], SCHEMA)
    got = {r["page_id"]: r["text"] for r in P.extract_pages(df.union(df)).collect()}
    for k, w in enumerate(want):
        if w is not None:
            # pages of one host differ wildly here: each still gives its own text
            assert got[k] == w, (k, got[k][:80], w[:80])


def _page(body):
    return P.wrapper_of(P.parse(body))


def test_alignment_infers_slots_options_and_repeats():
    a = _page("<h1>Same</h1><p>one</p><p>two</p><i>x</i><div>tail</div>")
    b = _page("<h1>Same</h1><p>three</p><section>only here</section><div>tail</div>")
    w = P.align(a, b)
    by = {P._key(p): p for p in w}
    assert by["h1"][6] == [["t", "Same", False, 8]]
    assert by["p"][5] and by["p"][6][0][1] is None
    assert by["section"][4] and not by["div"][4]


def test_groups_fold():
    w = _page("<dl>" + "<dt>k</dt><dd>v</dd>" * 5 + "</dl>")
    assert [p[0] for p in w[0][6]] == ["g"] and w[0][6][0][2]


def test_a_wrapper_stays_small():
    rng = random.Random(1)
    w = None
    for k in range(300):
        parts = _page(blog(rng, k)[0])
        w = parts if w is None else P.align(w, parts)
    assert len(json.dumps(w)) < 20_000


def test_empty_table(spark):
    assert P.extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def _extract(spark, pages, host="a.org"):
    df = spark.createDataFrame([(k, f"http://{host}/{k}", p, None, None) for k, p in enumerate(pages)], SCHEMA)
    return {r["page_id"]: r["text"] for r in P.extract_pages(df).collect()}


def test_class_words_of_the_articles_own_blocks(spark):
    rng = random.Random(7)
    pages, want = [], []
    for k in range(12):
        own = [words(rng, 12) for _ in range(6)]
        pages.append(
            f"<html><body><nav class=menu>Menu</nav><div class='notice'>Site closed {k}</div><article><h1>H{k}</h1>"
            f"<p class='share'>{own[0]}</p><p class=alert>{own[1]}</p><div class='notice-board'>{own[2]}</div>"
            f"<ul class='related-work'><li>{own[3]}</li></ul><p class='share-price'>{own[4]}</p>"
            f"<p style='overflow: hidden' data-class='ad'>{own[5]}</p>"
            f"<p class=notice>This site keeps all its pages</p><p class=related><a href=x>{words(rng, 3)}</a></p>"
            f"<div class='share-buttons'>Tweet {k} <span>Like</span></div><p class='ad'>Buy {k}</p>"
            f"<div class='site-footer'>foot {k}</div></article><footer>end</footer></body></html>")
        want.append("\n".join([f"H{k}", *own]))
    got = _extract(spark, pages)
    for k, w in enumerate(want):
        assert got[k] == w
    # a page alone on its host: nothing shows its blocks to be template
    alone = _extract(spark, ["<article><p class='share'>one</p><p class='alert'>two</p></article>"], "alone.org")
    assert alone == {0: "one\ntwo"}


def test_parts_below_many_elements(spark):
    deep = "<div>" * 200 + "<p>kept</p><nav>menu <p>menu</p></nav>also<div class=cookie-notice>ok</div><p>end</p>" + "</div>" * 200
    got = _extract(spark, [deep, "<article>" + deep + "</article>"])
    assert got == {0: "kept\nalso\nend", 1: "kept\nalso\nend"}
    many = "<div><span>" * 60_000 + "text" + "</i></section>" * 60_000  # unclosed, and closed without being open
    assert _extract(spark, [many]) == {0: "text"}


def test_stray_quotes(spark):
    pages = {"<p class=\"x>Broken quote text": "Broken quote text", "<p class=x\">one</p>": "one",
             "<p title='a>b'>two</p>": "two", "<p title=\"it's\">three</p><p title='x'>four</p>": "three\nfour",
             "<p =x>five</p>": "five", "<p a = b c='d' / e>six</p>": "six", "<p class= >seven</p>": "seven",
             "a < b and <3": "a < b and <3", "<a href=x/>eight</a>": "eight"}
    got = _extract(spark, list(pages))
    assert got == dict(enumerate(pages.values()))
    assert len(P.parse("<p " + "a='" * 100_000 + ">x").content) == 1  # no long search
