import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ENTRY
from feedlens.llm import html_extract as H

#: what a page looks like around its article
AROUND = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head>
<body class="page has-sidebar"><header class="site"><h1>Site name</h1><form><input name=q><button>Go now</button></form></header>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><div class="ad">Buy these goods now, cheap.</div>
{}<aside>Other things to read on this page</aside><div id="cookie-notice">We use cookies, accept them all.</div>
<footer>&copy; all rights</footer></body></html>"""
ARTICLE = """<h1>The title &lt;here&gt;</h1><p>First&nbsp;para <b>bold</b>er,
   with <a href="x?a>b" title="1 > 0">a link</a>.<br>New line.<p>Second, never closed &eacute;&#233;&#x1F642;<ul><li>item one<li>item two</ul>
<div class="advert">Advert inside</div><figure><img src=x><figcaption>Caption</figcaption></figure><form>Your mail <input></form>
<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><blockquote>Quoted.</blockquote><script>x<p></script>"""
WANT = ["The title <here>", "First para bolder, with a link. New line.", "Second, never closed éé🙂", "item one", "item two", "Caption", "a b", "c", "Quoted."]
COMMENTS = '<section class="comments"><h3>2 comments</h3><article><p>I like this text very much, as it is long and good.</p></article></section>'


def truth(html):
    """The blocks between the article's tags, by what the tables' pages hold."""
    inside = html[html.index("<article>") + 9:html.index("</article>")]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def weights(spark, sf):
    return H.train(spark.read.parquet(f"{sf}/pages.parquet"))


def test_query_equals_the_marked_text(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
        rows = ENTRY.queries()["op11_html_extraction"](spark, sf_dir).collect()
        assert len(rows) == len(pages)
        for r in rows:
            assert r["text"] == truth(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_region_without_any_mark(spark, weights):
    """The scan alone: the same pages with bare divs in place of every telling element."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")
        assert H.main_text(bare, weights)[0] == truth(r["html"])


@pytest.mark.parametrize("wrap", ["<article>{}</article>" + COMMENTS, "<main><article>{}</article>" + COMMENTS + "</main>",
                                  '<form id="aspnet"><article><header><p>By someone</p></header>{}' + COMMENTS + "</article></form>",
                                  '<div class="post-body">{}</div>' + COMMENTS.replace("section", "div"), "<main>{}</main>",
                                  "<nav><ul><li><a>never closed</a><article>{}</article>" + COMMENTS])
def test_layouts(weights, wrap):
    text, score = H.main_text(AROUND.format(wrap.format(ARTICLE)), weights)
    assert text == "\n\n".join(WANT) and score > 0


def test_weights_are_learned(spark, weights):
    assert all(w > 0 for k, w in weights.items() if k.startswith("w ")) and all(w < 0 for k, w in weights.items() if not k.startswith("w "))
    assert weights["p"] > weights["li"] and weights["w p"] > weights["w a"]
    odd = spark.createDataFrame([(f"<body><nav><p>{'menu ' * 50}</p></nav><article><div>{'word ' * 9}</div></article>{i}",) for i in range(80)], "html string")
    other = H.train(odd)
    assert other["p"] < weights["p"] and other["div"] > weights["div"] and other["w p"] < weights["w p"]
    assert H.train(odd.limit(0)) == {k: H.weight(k, 0, 0) for k in H.train(odd.limit(0))}      # the prior


def test_odd_pages(spark, weights):
    rows = [(1, None, None), (2, "u", ""), (None, "v", "just text &amp; more"), (4, "w", "a < b and <3 &c &amp d"), (5, "x", "<nav>menu only"),
            (6, "y", "<p>ends in a tag <b"), (7, "z", "<!-- open <p>x"), (8, "z", "<p hidden>no</p><p style='display: none'>no</p><p>yes</p>"),
            (9, "q", "<p>x" + "word " * 300_000), (9, "q", "<p>x" + "word " * 300_000), (10, "r", "<P CLASS='A'>Upper</P><SCRIPT>x</SCRIPT >after")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "score", "key", "n", "kind")})
    got = sorted(H.extract(pages, weights).collect(), key=lambda r: (r["page_id"] is not None, r["page_id"] or 0))
    assert [r["text"] for r in got[:9]] == ["just text & more", "", "", "a < b and <3 &c & d", "", "ends in a tag", "", "yes", "x" + ("word " * 300_000).strip()]
    assert got[9]["text"] == got[8]["text"] and got[10]["text"] == "Upper\n\nafter"
    assert H.extract(pages.limit(0), H.train(pages.limit(0))).count() == 0


@pytest.mark.parametrize("piece", ['<a "', "<p>", "<div>x ", "</div>", "<b><p>x", "<script>", "<", '<a b="x>', "<span class=ad>", "<article>", "<article><header><h2>", "&", "<!", "<li><dt><td>"])
def test_hostile_pages_take_linear_time(weights, piece):
    t = time.time()
    H.main_text(piece * (1_000_000 // len(piece)), weights)
    assert time.time() - t < 15
