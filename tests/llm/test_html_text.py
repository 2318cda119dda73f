"""Main text against an independent parser on whole pages, on hostile markup, and on names that only look like boilerplate."""

import os
import time
from html.parser import HTMLParser

import pandas as pd
import pytest

from lodegraph.llm import html_text as H

DATA = "/root/testdata/sf0.01/pages.parquet"


class Article(HTMLParser):
    """The text inside article elements, by the standard library's parser."""

    SKIP = {"script", "style", "nav", "aside", "form", "footer"}
    INLINE = {"b", "i", "a", "em", "strong", "span"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.out = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in self.SKIP
        if tag not in self.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in self.SKIP
        if tag not in self.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.out.append(data)


def by_the_library(page):
    p = Article()
    p.feed(page)
    p.close()
    return " ".join("".join(p.out).split())


@pytest.mark.skipif(not os.path.exists(DATA), reason="no data")
def test_all_pages_against_an_independent_parser(spark):
    pages = pd.read_parquet(DATA)
    want = {i: by_the_library(h) if isinstance(h, str) else "" for i, h in zip(pages["page_id"], pages["html"], strict=True)}
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.read.parquet(DATA)).select("page_id", "text").collect()}
    assert got == want and sum(map(bool, want.values())) > 0.9 * len(want)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="content overflow-hidden"><p>Some text here.</p></div>', "Some text here."),
        ('<div class="layout has-sidebar"><article><p>Text in it.</p></article></div>', "Text in it."),
        ('<article><p title="a hidden gem">One here.</p><p class="share-price">Two here.</p></article>', "One here. Two here."),
        ('<form id="aspnetForm"><article><p>In a form.</p><form>Drop</form></article></form>', "In a form."),
        ('<div class="sidebar-layout"><p>The only text of this page.</p></div>', "The only text of this page."),
        ('<article><p>a</p><div class="comments"><p>no</p></div><div id="ad-slot-3">buy</div><div class="share-buttons">x</div></article>', "a"),
        ("<article><p data-x='a > b' class=\"x\">kept</p><!-- <p>no --><p>too</p></article>", "kept too"),
        ("<article><p>5 < 6 and <b>x</b>", "5 < 6 and x"),
    ],
)
def test_names_that_look_like_boilerplate(page, want):
    assert H.main_text(page) == want
    assert H.main_text(page, H.votes(page)[0][0]) == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, 'a < b <b c" ' * 90_000, "<div>" * 100_000 + "</x>" * 100_000 + "t", "<p><object>" + "<b>" * 100_000 + "<div></div>" * 50_000, "<a b='<q c=\">\" ' " * 60_000, "<li><ul>" + "<div>" * 30_000 + "<li></li>" * 30_000, "<p>word " * 100_000],
    ids=["open tags", "stray quotes", "deep", "deep inline", "nested quotes", "items", "long"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    H.main_text(page)
    H.votes(page)
    assert time.process_time() - began < 20  # quadratic time would take hours


def test_long_page_is_taken_whole():
    page = "<article>" + "<p>Many words.</p>" * 60_000 + "</article>"
    assert H.main_text(page) == " ".join(["Many words."] * 60_000)
