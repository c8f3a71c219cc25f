import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import extraction as x


@pytest.fixture(scope="module")
def model():
    return x.train(x.composed_trees(x.COMPOSED))


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings."""
    tree = x.parse("<div><p>a b</p><ul><li>c<li>d</ul></div><footer>e</footer>")
    n = len(tree.parent)
    assert n <= 13
    model, rng = x.Model(), np.random.default_rng(1)
    names = sorted({f for fs in tree.features for f in fs})
    model.weights, model.edge = dict(zip(names, rng.normal(size=len(names)).tolist(), strict=True)), rng.normal(size=(2, 2, 2))
    total, ones = 0.0, np.zeros(n)
    for y in product((0, 1), repeat=n):
        s = sum(model.weights[f] for k in range(n) if y[k] for f in tree.features[k])
        s += sum(model.edge[int(tree.features[k][0] == "leaf"), y[tree.parent[k]], y[k]] for k in range(1, n))
        total += np.exp(s)
        ones += np.exp(s) * np.array(y)
    assert np.allclose(x.marginals(model, tree), ones / total)


def test_forests_agree_with_single_trees():
    labelled = x.composed_trees(30, seed=5)
    names = sorted({f for tree, _ in labelled for fs in tree.features for f in fs})
    rng, model = np.random.default_rng(2), x.Model()
    w, model.edge = rng.normal(size=len(names)), rng.normal(size=(2, 2, 2))
    model.weights = dict(zip(names, w.tolist(), strict=True))
    p, moves = x.Forest(labelled, {f: i for i, f in enumerate(names)}).marginals(w, model.edge)
    assert np.allclose(p, [q for tree, _ in labelled for q in x.marginals(model, tree)])
    assert np.isclose(moves.sum(), sum(len(tree.parent) - 1 for tree, _ in labelled))
    inner = [(int(tree.features[k][0] == "leaf"), x.marginals(model, tree)[k]) for tree, _ in labelled for k in range(1, len(tree.parent))]
    assert np.allclose([moves[kind, :, 1].sum() for kind in (0, 1)], [sum(q for k, q in inner if k == kind) for kind in (0, 1)])


def test_held_out_pages(model):
    right = total = 0
    for page, y in x.composed(200, seed=99):
        tree = x.parse(page)
        assert len(tree.texts) == len(y)
        tree.features = [[f for f in fs if "=zz" not in f] for fs in tree.features]
        p = x.marginals(model, tree)
        right += sum((p[k] >= 0.5) == t for k, t in zip(tree.leaf_of, y, strict=True))
        total += len(y)
    assert right / total > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var t="<p>no</p>";</script></head><body>
<header class="masthead"><div>Site name</div></header><nav><ul><li><a href=/a>Home</a><li><a href="/b">News &amp; more</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>
<article><h1>A &lt;title&gt; &eacute;</h1><p>First   paragraph,\n with <a href="/x">a link</a> inside&nbsp;it.<br>After a break.
<p><b>Second paragraph is here, left open.<p>Third &#8212; with entities &unknown; &copy stays.<div class="ad">Buy this thing now.</div>
<ul><li>one item in a list of things.</li><li>two</li></ul>
<form><p>Sign up</p><input name=q><button>Go</button></form>
<div class="comments"><div class="comment"><p>I liked this article very much, thank you.</p></div></div></article>
<aside><h3>Related</h3><p>Other things to read today.</p></aside><!-- <p>hidden</p> --><footer>&copy; example.com</footer></body></html>"""
TEXT = "A <title> é\nFirst paragraph, with a link inside it. After a break.\nSecond paragraph is here, left open.\nThird — with entities &unknown; © stays.\none item in a list of things.\ntwo"


def test_a_page(model):
    assert x.content(model, PAGE) == TEXT


#: Pages written by hand in the manner of sites of several kinds, and the lines that are their text.
FOREIGN = {
    "news": (
        """<html><body><div id="top-bar"><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></div>
<div class="layout"><div class="story-body"><h1>Harbour bridge to close for repairs</h1><p class="byline">By A. Reporter, 4 May</p>
<p>The bridge over the old harbour will close for six weeks from Monday, the city said on Friday.</p>
<p>Engineers found rust in two of its main cables during an inspection last month.</p>
<div class="advert"><p>Fly cheaper this summer. Book now!</p></div>
<p>Buses will be sent around by the northern road, and the ferry will run twice as often.</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href=1>Rain ahead</a></li><li><a href=2>Match report</a></li></ul></div></div>
<footer><p>&copy; The Harbour Post. All rights reserved.</p></footer></body></html>""",
        ["Harbour bridge to close for repairs", "The bridge over the old harbour will close for six weeks from Monday, the city said on Friday.", "Engineers found rust in two of its main cables during an inspection last month.", "Buses will be sent around by the northern road, and the ferry will run twice as often."],
    ),
    "blog": (
        """<body><header><h1>My garden notes</h1><p>Thoughts on soil</p></header><main><article class="post-share"><h2>Planting beans</h2>
<p>I planted the first beans today, a week later than last year, because the ground was still cold.</p><ul><li>Soak them overnight.</li><li>Plant them two fingers deep.</li></ul>
<p>In ten days they should be up.</p></article><div id="comments"><h3>2 comments</h3><div class="comment"><p>Mine came up already, lucky me.</p></div></div></main>
<form class="newsletter"><p>Get my notes by mail</p><input name=m><button>Subscribe</button></form></body>""",
        ["Planting beans", "I planted the first beans today, a week later than last year, because the ground was still cold.", "Soak them overnight.", "Plant them two fingers deep.", "In ten days they should be up."],
    ),
    "plain": ("""<body><div class="wrap"><p>This is a short note that somebody put on the web.</p><p>It has two paragraphs and nothing else.</p></div></body>""", ["This is a short note that somebody put on the web.", "It has two paragraphs and nothing else."]),
    "shared": ("""<body><div class="post-share"><p>A first paragraph with some words in it, as people write them.</p><p>And another one after it, which ends here.</p></div></body>""", ["A first paragraph with some words in it, as people write them.", "And another one after it, which ends here."]),
    "manual": (
        """<body><nav class="breadcrumbs"><a href=a>Docs</a> / <a href=b>Tools</a></nav><section class="content"><h1>Installing the tool</h1><p>Unpack the archive and copy the program to a folder on your path.</p>
<pre>cp tool /usr/local/bin</pre><h2>Checking</h2><p>Run it once without arguments; it prints its version.</p></section><aside><h4>On this page</h4><ul><li><a href=#1>Installing</a></li><li><a href=#2>Checking</a></li></ul></aside></body>""",
        ["Installing the tool", "Unpack the archive and copy the program to a folder on your path.", "cp tool /usr/local/bin", "Checking", "Run it once without arguments; it prints its version."],
    ),
    "old": (
        """<HTML><BODY><TABLE><TR><TD><A HREF=index.htm>Main page</A></TD><TD><A HREF=links.htm>Links</A></TD></TR></TABLE><H1>The old mill</H1>
<P>The mill was built in 1784 by two brothers who had come from the coast.<P>It burned down twice, and was rebuilt both times with the stones of the first one.
<P>Since 1960 it has been a museum.<HR></BODY></HTML>""",
        ["The old mill", "The mill was built in 1784 by two brothers who had come from the coast.", "It burned down twice, and was rebuilt both times with the stones of the first one.", "Since 1960 it has been a museum."],
    ),
    "shop": (
        """<body><div class="cookie-banner"><p>We use cookies. <a href=c>Settings</a></p><button>Accept</button></div><div class="page"><div class="entry"><h1>How we roast our coffee</h1>
<p>Every batch is small, and every batch is tasted before it leaves the house.</p><p>The beans rest for two days, so that the gas can escape.</p></div></div><div class="related"><h3>You may also like</h3><p>Filter papers</p><p>Hand grinder</p></div></body>""",
        ["How we roast our coffee", "Every batch is small, and every batch is tasted before it leaves the house.", "The beans rest for two days, so that the gas can escape."],
    ),
}


def test_a_short_unmarked_page_keeps_its_text(model):
    page, lines = FOREIGN["plain"]
    assert x.content(model, page).split("\n") == lines


def test_foreign_pages(model):
    """Lines found and lines told, over pages that neither the composer nor the table had a part in."""
    found = wanted = right = 0
    for page, lines in FOREIGN.values():
        got = x.content(model, page).split("\n")
        found, wanted, right = found + len(got), wanted + len(lines), right + len(set(got) & set(lines))
    assert right / wanted > 0.9 and right / found > 0.8


def test_hidden_elements_nest():
    inside = "<svg><g><svg><text>no</text></svg><text>neither</text></g></svg>"
    assert x.parse(f"<p>Before.</p>{inside}<object><object>no</object>nor this</object><p>After.</p>").texts == ["Before.", "After."]


@pytest.mark.parametrize("html", ["<div>" * 40_000 + "</span>" * 40_000 + "text", "<x-y>" * 20_000 + "<p>text", "<b>" * 40_000 + "<br>x" * 40_000, "<p>" + "<i>" * 5_000 + "</u>" * 40_000 + "text"])
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    assert x.parse(html).texts
    assert time.process_time() - began < 3


@pytest.mark.parametrize("html", ["", None, " ", "<", "<p", "</p></div>", "<script>", "<!-- open", "a < b & c", "<p>" * 3000, "<a><b>x" * 500, "<div class='>'>x</div>"])
def test_odd_markup_does_not_crash(model, html):
    assert isinstance(x.content(model, html), str)


def test_long_page(model):
    long = "<article>" + "<p>Some words of a long text, which go on.</p>" * 20_000 + "</article>"
    assert x.content(model, long).count("\n") == 19_999


def test_query(spark, tables):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>Plain words in a page of their own.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("_key", F.lit(1))
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in x.op5_extraction(spark, tables(pages=pages)).collect()}
    assert got == {(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0), (3, "w", "Plain words in a page of their own.", 35)}
    assert x.extracted(pages.where("false"), x.fit(pages.where("false"))).count() == 0


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea", "iframe"])
def test_raw_text_ends_at_its_end_tag(tag):
    assert x.parse(f"<{tag}><!-- x=1; </{tag.upper()} ><p>The article.</p>").texts == ["The article."]
    assert x.parse(f"<p>Before.</p><{tag}>no <b>end</b> </{tag}x>").texts == ["Before."]
