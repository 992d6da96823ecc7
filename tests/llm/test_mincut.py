import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm.mincut import main_text, main_texts, minimum_cut, read_blocks
from lodestone.llm.queries import QUERIES


def cost(labels, scores, edges):
    wrong = sum(abs(s) for keep, s in zip(labels, scores, strict=True) if keep != (s > 0))
    return wrong + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        scores = [rng.randint(-30, 30) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([10, 20])) for _ in range(rng.randint(0, 14))]
        got = minimum_cut(scores, edges)
        assert cost(got, scores, edges) == min(cost(x, scores, edges) for x in itertools.product([False, True], repeat=n))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class='cookie-notice'><p>We use cookies on this site to make it a better place for all of our readers.</p></div>
<div id="main-content"><article><header><h1>The &quot;title&quot; &amp; more</h1></header>
<!-- no > text --><p>First <b>bold</b>&nbsp;paragraph,<br>two lines.<p>Ok.<script>if (a<b) { x("</p>") }</script>
<ul><li>one<li>two <i>x</i></ul><div class="ad"><p>Buy this now because it is a very good thing to have.</p></div>
<div class="shareBar">Share</div></article>
<section class="comments"><article><p>I read this with great interest and would like to disagree.</p></article></section></div>
<aside><p>Other stories that you may want to read some day.</p></aside><form><p>Your name</p><textarea>x</textarea></form>
<footer>&copy; me</footer>"""


def test_page_parts():
    assert main_text(PAGE) == 'The "title" & more\nFirst bold paragraph, two lines.\nOk.\none\ntwo x'


def test_page_without_article_uses_text_and_neighbours():
    long = "A sentence of quite some words that says what the page is about."
    assert main_text(f"<div><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=x>Home</a> <a href=y>About</a></div>") == f"{long}\nShort.\n{long}"


LONG = "A sentence of quite some words that says what the page is about and why anyone would want to read on."


@pytest.mark.parametrize("name", ["select", "textarea", "object", "svg", "math", "title", "iframe", "noscript", "template", "script", "style"])
def test_raw_elements_without_an_end(name):
    assert main_text(f"<{name}>x<article><p>{LONG}</p></article>") == LONG
    if name not in ("script", "style"):  # code runs to the next end tag: it may quote tags
        assert main_text(f"<{name}>x<article><p>{LONG}</p></article><{name}>y</{name}>") == LONG
    assert main_text(f"<article><p>a <{name}><p>no</p></{name}>{LONG}</p></article>") == f"a {LONG}"


def test_head_without_an_end():
    assert main_text(f"<html><head><title>t</title><meta charset=x><style>p{{}}</style><body><article><p>{LONG}</p></article>") == LONG
    assert main_text(f"<select><option>a<option>b<div><p>{LONG}</p></div>") == LONG


@pytest.mark.parametrize("mark", ["no-sidebar", "header-fixed", "has-share"])
def test_wrappers_with_chrome_words(mark):
    for tag in ("html", "body", "div", "form"):
        assert main_text(f"<{tag} class='{mark}'><nav>Home</nav><div><p>{LONG}</p><p>{LONG}</p></div></{tag}>") == f"{LONG}\n{LONG}"
    more = f"{LONG} {LONG}"
    assert main_text(f"<div class='{mark}'><p>{more}</p><p>{more}</p><p>Ok.</p><p>{more}</p></div><div>Small print</div>") == f"{more}\n{more}\nOk.\n{more}"
    assert main_text(f"<article><p>{LONG}</p></article><div class='{mark}'><p>{more}</p></div>") == LONG


def test_compound_classes_and_linked_lists_in_an_article():
    more = f"{LONG} {LONG}"
    for mark in ("social-history", "header-files explained", "searchTheory"):
        assert main_text(f"<article><p>{LONG}</p><section class='{mark}'><p>{more}</p></section></article>") == f"{LONG}\n{more}"
    for mark in ("social", "share-search", "ad-box", "social-history comments", "newsletterBox", "related"):
        assert main_text(f"<article><p>{LONG}</p><section class='{mark}'><p>{more}</p></section></article>") == LONG
    assert main_text(f"<article><p>{LONG}</p><ul><li><a href=x>item</a></li><li><a href=y>other item</a></li></ul></article>") == f"{LONG}\nitem\nother item"
    assert main_text(f"<article><p>{LONG}</p></article><div class='social-history'><p>{more}</p></div><ul><li><a href=x>item</a></li></ul>") == LONG


def test_many_elements_without_an_end():
    assert main_text("<svg>" * 20000 + f"<script>x" * 20000 + f"<p>{LONG}") == LONG


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>", "</p></div>", "<a href='x>y", "<nav>x</nav>", "<![foo[bar]]>", "&#xD800;<p>"])
def test_odd_pages(page):
    assert "<" not in main_text(page) or page in ("<", "<p", "<a href='x>y")


def test_long_and_deep_pages():
    assert len(main_text("<article>" + "<p>Ha.</p>" * 20000 + "</article>").split("\n")) == 20000
    assert len(read_blocks("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_rows(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = df.select("page_id", main_texts(F.col("html")).alias("text")).collect()
    assert sorted((r["text"] for r in got)) == ["", main_text(PAGE), main_text(PAGE)]
    assert df.limit(0).select(main_texts(F.col("html"))).count() == 0


def test_query_against_the_pages_articles(spark, sf_dir):
    got = {r["page_id"]: r for r in QUERIES["op8_html"](spark, sf_dir).collect()}
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", page["html"], re.S)[1]
        parts = re.split(r"</?(?:h1|p|body|html|footer)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        want = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        r = got[page["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], want, len(want))
