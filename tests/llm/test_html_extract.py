import html
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import CLASHING, stored
from locuswise.llm import html_extract
from locuswise.llm.common import table


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_blocks_of_loose_markup():
    page = "<!-- x --><p>a &amp; b<p>c<br>d<ul><li>e<li>f</ul><script>var t='</p>';</script>g < h <b>i</b>j<table><tr><td>k<td>l</table><style>p{}"
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["a & b", "c d", "e", "f", "g < h ij", "k", "l"]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "</p></p>", "<script>x", "<a \"b", "&#0;&#xD800;&bad;", "<p " + "a" * 50_000, "<div>" * 3000 + "x"])
def test_broken_pages_do_not_fail(model, page):
    html_extract.main_blocks(page, model)


def test_unseen_layouts(model):
    wrong = total = 0
    for page, main in html_extract.labelled_pages(150, seed=123):
        blocks = html_extract.leaf_blocks(page)
        path = html_extract.viterbi(model.emissions(html_extract.block_features(blocks)), model)
        wrong += sum(bool(y) != (k in main) for k, y in enumerate(path))
        total += len(blocks)
    assert wrong / total < 0.01


def test_one_page(model):
    page = """<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>A  title</h1><p>First&nbsp;one.</p><div class="ad">Buy now</div><p>Second.</p>
    <form><label>Your email</label></form></article><aside>Related</aside><section class="comments"><div class="comment">Nice one</div></section><footer>&copy; x</footer>"""
    assert html_extract.main_blocks(page, model) == ["A title", "First one.", "Second."]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>x</p></article>", ["x"]),
        ("<html><body><p>Just a paragraph, no more than that.</p></body></html>", ["Just a paragraph, no more than that."]),
        ("<article><p>Search</p><p>Reply to this question was short.</p></article>", ["Search", "Reply to this question was short."]),
        ("<article><p>We use cookies in baking, and this is how.</p></article>", ["We use cookies in baking, and this is how."]),
        ("<body><h1>Title</h1><p>First words.</p><p>And more words.</p></body>", ["Title", "First words.", "And more words."]),
        ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><p>Ok.</p></article><footer>x</footer></body></html>", ["Ok."]),
        ("plain text only", ["plain text only"]),
        ("<p>One.<p>Two.", ["One.", "Two."]),
        ("<main><h1>Home</h1><p>Home Home Home.</p></main><footer>&copy; 2024 All rights reserved.</footer>", ["Home", "Home Home Home."]),
        ("<html><body><div class=header>The daily page</div><div class=content><p>A line.</p></div><div class=comments><p>Great article!</p></div></body></html>", ["A line."]),
        ("<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav></body></html>", []),
    ],
)
def test_written_layouts(model, page, want):
    assert html_extract.main_blocks(page, model) == want


@pytest.mark.parametrize("unit", ["<div>", "<div>x", "<p>x", "<b>", "<a ", '<a "', "<!-- ", "<div class=a>x", "<li>x", "<td>x"])
def test_time_grows_with_the_page_only(unit):
    start = time.time()
    html_extract.leaf_blocks(unit * 20_000)
    assert time.time() - start < 3


def test_every_page_of_a_larger_table(model):
    wrong = 0
    for row in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        inner = row["html"].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        wrong += html_extract.main_blocks(row["html"], model) != [p for p in parts if p]
    assert wrong == 0


def test_whole_table_gives_the_articles(spark, small):
    pages = {r.page_id: r.html for r in table(spark, small, "pages").collect()}
    got = html_extract.query(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, tmp_path, model, clashing):
    long = "<article>" + "<p>Some words here and there.</p>" * 5000 + "</article>"
    rows = [(1, None, None), (1, None, None), (2, "http://a", ""), (None, "u", "<article><p>x</p></article>"), (3, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    if clashing:
        df = df.withColumns({c: F.lit("mine") for c in [*CLASHING, "text"]})
    got = html_extract.extracted(stored(df, tmp_path), model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:3] == [(0, 1), (1, 0), (1, 0)]
    assert max(r.n_chars for r in got) == 5000 * 27 - 2
    assert html_extract.extracted(stored(df.limit(0), tmp_path), model).count() == 0


def test_long_and_short_pages_are_read_whole(spark, tmp_path, model):
    said = "Some words here and there."
    rows = [(1, "u", "<article>" + f"<p>{said}</p>" * 5000 + "</article>"), (2, "u", "<article><p>x</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extracted(stored(df, tmp_path), model).collect()}
    assert got[1].text == "\n\n".join([said] * 5000) and got[1].n_chars == 5000 * 26 + 4999 * 2
    assert (got[2].text, got[2].n_chars) == ("x", 1)
