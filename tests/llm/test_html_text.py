"""Page text against a plain reading of simple pages, and against hand-written pages of other make."""

import re
import time
from html import unescape

import pytest

from noticeworks.llm import html_text
from noticeworks.llm.common import open_table

LONG = "It was a long and quiet morning, and the whole of the town had gone down to the river to see the boats. "


def plain(html):
    """The article of a page whose article element holds nothing but headings and paragraphs."""
    body = html[html.index("<article>") + 9 : html.index("</article>")]
    parts = (" ".join(unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split("</?(?:p|h1)>", body))
    return "\n\n".join(part for part in parts if part)


def test_every_page_of_the_table(spark, small_dir):
    pages = open_table(spark, small_dir, "pages")
    html = {row.page_id: row.html for row in pages.collect()}
    got = html_text.extracted(pages).collect()
    assert len(got) == len(html)
    for row in got:
        assert row.text == plain(html[row.page_id]) and row.n_chars == len(row.text)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("a", "a"),
        ("a &lt; b &amp;amp; c &#233;&#x41;&nbsp;d &am", "a < b &amp; c éA d &am"),
        ("<p>one<br>two  <b>th</b>ree<p>four", "one two three\n\nfour"),
        ("<p>one <script>var x = '<p>no</p>';</script>two</p>", "one two"),
        ("<p>one</p><!-- <p>no</p> --><p>two</p><!-- no", "one\n\ntwo"),
        ("<p>one</p></div></b><p>two</p><a href='x", "one\n\ntwo"),
        ("<p title='a > b' data-x=\"</p>\">one</p>", "one"),
        ("1 < 2 <3 </ x> y", "1 < 2 <3 y"),
        ("<style>p{}</style><title>t</title><p>one", "one"),
        ("<head><title>t</title><p>one</p>", "one"),
        ("<SCRIPT>x</SCRIPT\n><P>one</P>", "one"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one\n\ntwo\n\na\n\nb"),
    ],
)
def test_small_pages(html, text):
    assert html_text.main_text(html) == text


def page(article, before="", after=""):
    return f"<html><body><div id='site'>{before}{article}{after}</div></body></html>"


MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(30)) + "</ul>"


def paragraphs(count):
    return "".join(f"<p>{i} {LONG}</p>" for i in range(count))


def blocks_of(count):
    return [f"{i} {LONG.strip()}" for i in range(count)]


def test_unmarked_menus_fall_below_the_article():
    html = page(f"<div class='x1'><h1>Title</h1>{paragraphs(6)}</div>", f"<div>{MENU}</div>", f"<div>{MENU}</div>")
    assert html_text.main_text(html) == "\n\n".join(["Title", *blocks_of(6)])


def test_article_is_whole_with_short_blocks_and_wrappers():
    html = page(
        f"<article><header><h1>Title</h1></header><p>Short.</p><div class='body'>{paragraphs(5)}</div><p>End.</p>"
        f"<div class='related'>{MENU}</div></article>",
        f"<header>Site <nav>{MENU}</nav></header>",
        "<footer>Imprint</footer>",
    )
    assert html_text.main_text(html) == "\n\n".join(["Title", "Short.", *blocks_of(5), "End."])


@pytest.mark.parametrize(
    "noise",
    [
        f"<div class='ad-box'>{LONG * 9}</div>",
        f"<div id=comments><p>{LONG * 9}</p></div>",
        f"<section class='postComments'><article class='comment'><p>{LONG}</p></article></section>",
        f"<aside><p>{LONG * 9}</p></aside>",
        f"<div role='complementary'><p>{LONG}</p></div>",
        f"<form><p>{LONG}</p><label>Name</label><input value='x'></form>",
        f"<div class='cookie-notice'><p>{LONG * 9}</p></div>",
        f"<noscript><p>{LONG}</p></noscript>",
        f"<nav>{LONG * 9}",
        "<span class='advert'>Buy</span>",
        "<select><option>One<option>Two</select>",
        "<textarea><p>no</textarea>",
        f"<template><p>{LONG}</p></template>",
    ],
)
def test_noise_in_and_around_the_article(noise):
    wanted = "\n\n".join(["Title", *blocks_of(4)])
    assert html_text.main_text(page(f"<article><h1>Title</h1>{paragraphs(4)}{noise}</article>", noise if "<nav" not in noise else "")) == wanted
    assert html_text.main_text(page(f"<div><h1>Title</h1>{paragraphs(4)}{noise}</div>")) == wanted


def test_forms_and_layout_names_around_a_page_take_nothing():
    article = f"<main><h1>Title</h1>{paragraphs(3)}</main>"
    wanted = "\n\n".join(["Title", *blocks_of(3)])
    for html in (
        f"<form id='frame'>{page(article)}</form>",
        f"<body class='has-sidebar'><div class='content-sidebar'>{article}</div><div class='sidebar'><p>{LONG}</p></div>",
        f"<div class='banner'>{article}</div>",
    ):
        assert html_text.main_text(html) == wanted


def test_hostile_pages_take_time_in_proportion():
    times = []
    for size in (20_000, 80_000):
        start = time.process_time()
        for part in ("<", "<a ", '<a "', "<a =\"", "<!--", "</", "<p>", "<div>", "<b>", "<li><b>", "</p>", "&", "<script>", "<ul><li>", "<a='"):
            html_text.main_text(part * size)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 1


def test_deep_nesting_and_long_text():
    assert html_text.main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert html_text.main_text("<p>" + "word " * 400_000) == ("word " * 400_000).strip()


def test_odd_rows(spark):
    rows = [(1, "u", "<p>one", 5, "x"), (1, "u", "<p>one", 5, "x"), (None, None, None, 1, None), (2, "", "", 0, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted(map(tuple, html_text.extracted(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "one", 3), (1, "u", "one", 3), (None, None, "", 0), (2, "", "", 0)], key=repr)
    assert html_text.extracted(pages.limit(0)).collect() == []
