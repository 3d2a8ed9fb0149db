"""HTML extraction: the article of every page, layouts with furniture, broken markup."""

import html
import re

import pytest

from evalspark.llm import htmltext as H

SCHEMA = "page_id long, url string, html string"


def article(page):
    """The blocks of the one <article> of a generated page."""
    inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = H.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "A sentence of the article, with commas, points and more. It goes on for a while, as articles do; then it ends."
LAYOUTS = {
    "div": '<div id="content"><h1>Title</h1><p>{0}</p><p>{0} Two.</p><p>Short.</p></div>',
    "article": "<main><article><header><h1>Title</h1></header><p>{0}</p><div><p>{0} Two.</p></div><p>Short.</p></article></main>",
    "flat": "<h1>Title</h1><p>{0}</p><p>{0} Two.</p><p>Short.</p>",
    "unclosed": "<section><h1>Title</h1><p>{0}<p>{0} Two.<p>Short.</section>",
    "table": "<table><tr><td><h1>Title</h1><p>{0}</p><p>{0} Two.</p><p>Short.</p></td></tr></table>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_article_without_furniture(name):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = '<p>x, y.</p>';</script></head><body>"
            "<header><a href='/'>Home, sweet home.</a></header><nav><ul><li><a>Menu, one.</a><li><a>Two</a></ul></nav>"
            f"<div class='cookie-notice'>{LONG}</div><!-- <p>{LONG}</p> -->" + LAYOUTS[name].format(LONG) +
            f"<aside><p>{LONG}</p></aside><div class='ad'>{LONG}</div><form><p>{LONG}</p><textarea>x</textarea></form>"
            f"<section id='comments'><p>{LONG}</p><p>{LONG}</p></section><footer>&copy; {LONG}</footer></body></html>")
    assert H.main_text(page) == f"Title\n{LONG}\n{LONG} Two.\nShort."


@pytest.mark.parametrize("wrapper", [
    '<main style="overflow:hidden">', '<div title="The hidden city">', '<div data-hidden="false" data-id="nav" data-role="form">',
    '<div class="overflow-hidden">', '<div class="col has-sidebar">', '<div class="no-comments">', '<article class="post-related">',
    '<div id="page" data-x=\'class="ad"\'>', '<form action="/x">', '<div class="sidebar">', '<div hidden>', '<div class="modal"><form>'])
def test_wrappers_are_not_furniture(wrapper):
    close = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrapper)))
    page = (f"<html><body><nav><ul><li><a>Menu, one.</a><li><a>Two</a></ul></nav>{wrapper}<h1>Title</h1><p>{LONG}</p><p>{LONG} Two.</p>"
            f"<p>Short.</p><div class='wide ad'>{LONG}</div>{close}<footer>{LONG}</footer></body></html>")
    assert H.main_text(page) == f"Title\n{LONG}\n{LONG} Two.\nShort."


@pytest.mark.parametrize("box", ["<div hidden>", "<div HIDDEN=''>", "<div class=\"x cookie-notice\">", "<div id=site_footer>", "<div role=navigation>",
                                 "<div aria-hidden='true'>", "<section class='comments'>"])
def test_furniture_beside_an_article(box):
    close = f"</{re.findall(r'<(\w+)', box)[0]}>"
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG} Two.</p></article>{box}" + f"<p>{LONG}</p>" * 4 + f"{close}</body>"
    assert H.main_text(page) == f"Title\n{LONG}\n{LONG} Two."


NAMES = ["user-comments", "post-comments", "reader-comments", "commentlist", "responses", "discussion", "reactions", "gdpr", "ad-slot",
         "ad-container", "adsbygoogle", "topnav", "col-sidebar", "related-posts", "share-buttons", "author-box", "siteFooter", "post_replies"]


@pytest.mark.parametrize("open_,close", [("<main>", "</main>"), ('<div id="story">', "</div>"), ("<div><div>", "</div></div>")])
@pytest.mark.parametrize("name", NAMES)
def test_named_boxes_within_the_article(name, open_, close):
    page = (f"<html><body>{open_}<h1>Title</h1><p>{LONG}</p><div class='x {name}'><p>{LONG}</p><p>Thanks, Bob!</p></div><p>{LONG} Two.</p>"
            f"<p>{LONG} Three.</p><div id='{name}'>{LONG}</div>{close}</body></html>")
    assert H.main_text(page) == f"Title\n{LONG}\n{LONG} Two.\n{LONG} Three."


@pytest.mark.parametrize("box", [
    "<div>&copy; 2024 The Paper, Inc.</div>", "<small>Copyright 2024, The Paper</small>", "<div>The Paper. All rights reserved.</div>",
    "<div><a href=a>Home</a> <a href=b>Sport, news</a></div>", "<ul><li><a href=a>One more story</a><li><a href=b>And another, long story of the day</a></ul>",
    "<h3>More</h3><ul><li><a href=a>One more story</a><li><a href=b>Another</a></ul>", "<div>Filed 3 May</div>"])
@pytest.mark.parametrize("open_,close", [("<main>", "</main>"), ("<div>", "</div>"), ("<div class=wrap><section>", "</section></div>")])
def test_unnamed_furniture_goes_by_its_path(box, open_, close):
    page = f"<body>{open_}<h1>Title</h1><p>{LONG}</p><h2>Part</h2><p>{LONG} Two.</p><p>{LONG} Three.</p>{box}{close}</body>"
    assert H.main_text(page) == f"Title\n{LONG}\nPart\n{LONG} Two.\n{LONG} Three."


def test_parts_of_an_article_stay():
    page = (f"<main><h1>Title</h1><div>By Ann</div><p>{LONG}</p><ul><li>One item</li><li>Two, see <a>there</a></li></ul><p>A <math><mi>x</mi></math> b</p>"
            f"<p>Press <button>Go</button> now.</p><h2><a href=x>Part</a></h2><p>{LONG} Two.</p><p><a href=y>A linked line</a></p><blockquote>Quote</blockquote>"
            "<p>Copyright law is old.</p></main>")
    assert H.main_text(page) == (f"Title\nBy Ann\n{LONG}\nOne item\nTwo, see there\nA x b\nPress Go now.\nPart\n{LONG} Two.\nA linked line\nQuote\n"
                                 "Copyright law is old.")
    unclosed = f"<main><a href=x><h1>Title</h1><p>{LONG}</p><p>{LONG} Two.</p></main>"
    assert H.main_text(unclosed) == f"Title\n{LONG}\n{LONG} Two."


def test_long_comments_beside_a_short_article():
    page = f"<body><div><h1>Title</h1><p>{LONG}</p><p>{LONG} Two.</p><div class='comments'>" + f"<p>{LONG}</p>" * 12 + "</div></div></body>"
    assert H.main_text(page) == f"Title\n{LONG}\n{LONG} Two."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), (" \n", ""), ("plain words", "plain words"), ("<p>a &lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;x</p>", "a <b> &amp; éé x"),
    ("<p>one\n\t two<br>three</p><p>four", "one two three\nfour"), ("a < b <c", "a < b"), ("<script>x", ""), ("<p title='a>b'>x</p>", "x"),
    ("<p title='a>x", "x"), ("</p></div>x", "x"), ("<![CDATA[a<b]]>", "a<b"), ("<P>A</P><P>B</P>", "A\nB"), ("<p>x<b>y</b>z</p>", "xyz"),
])
def test_small_pages(page, text):
    assert H.main_text(page) == text


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 50_000 + LONG) == LONG
    assert H.main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").count("\n") == 4999
    assert H.main_text("<b x='" * 3000 + LONG) is not None
    assert H.main_text("<" * 100_000) == "<" * 100_000


def test_edge_rows(spark, with_extras):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>")]
    got = sorted(map(tuple, H.extract(with_extras(spark.createDataFrame(rows, SCHEMA))).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", "x", 1), (2, "u", "x", 1)], key=str)
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []
