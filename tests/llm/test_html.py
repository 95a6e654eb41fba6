"""HTML extraction against pages that are made from a known article, hundreds of them, and against hostile ones."""

import html
import random
import time

import pytest
from pyspark.sql import functions as F

from inkfold.llm import html_extract, queries
from inkfold.llm.html_extract import main_text

ONE, TWO = "First paragraph, which is long enough, and has commas, to be found.", "Second one, with more text to read, for everyone who likes it."
AROUND = [
    "<nav><ul><li><a href=/a>Home, and more, of it</a></li><li><a href=/b>News</a></li></ul></nav>", "<div class='sidebar-content'><p>{}</p></div>", "<div class=\"widget widget_text\"><p>{}</p></div>",
    "<aside><p>{}</p></aside>", "<div id=comments><div class='comment-content'><p>{}</p></div></div>", "<div class='cookie-notice'><p>{}</p></div>", "<footer><p>{}</p></footer>", "<script>var x = '<p>{}</p>';</script>",
    "<div class='ad-content'><p>{}</p></div>", "<div role=navigation><p>{}</p></div>", "<form><p>{}</p><input value=x></form>", "<style>p {{ margin: 0 }}</style>", "<!-- <p>{}</p> -->", "<ul class=menu><li><a href=/c>{}</a></li></ul>",
    "<div hidden><p>{}</p></div>", "<div style='display: none'><p>{}</p></div>", "<noscript><p>{}</p></noscript>", "<section class='related-posts'><p>{}</p></section>", "<div class='newsletter'><p>{}</p></div>",
]
WRAPPERS = ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div class='entry-content'>{}</div>", "<main><article>{}</article></main>", "<div class='layout has-sidebar'><div class='post'>{}</div></div>", "<section class='story-body no-comments'>{}</section>", "<div class='page with-comments'><article>{}</article></div>"]


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma, and", "delta", "épsilon", "zeta,", "eta & theta", "iota < kappa", "lambda"]) for _ in range(n)).strip(",") + "."


def page(rng):
    """(html, main text)."""
    blocks, parts = [], []
    for k in range(rng.randrange(3, 9)):
        text = sentence(rng, rng.randrange(12, 40))
        blocks.append(text)
        source = html.escape(text).replace(" ", rng.choice([" ", "\n ", "  "]), 3)
        kind = rng.randrange(6) if k else 0
        if kind == 1:
            head = sentence(rng, 3)
            blocks.insert(-1, head)
            source = f"<h2>{html.escape(head)}</h2><p>{source}"
        elif kind == 2:
            more = sentence(rng, 20)
            blocks.append(more)
            source = f"<ul><li>{source}<li>{html.escape(more)}</ul>"
        elif kind == 3:
            source = f"<blockquote><p><em>{source}</em></p></blockquote>"
        else:
            source = rng.choice(["<p>{}</p>", "<p class='lead'>{}", "<P>{}</P>", "<p><b>{}</b></p>"]).format(source)
        parts.append(source)
        if rng.randrange(4) == 0:
            parts.append(f"<div class='ad'><p>{sentence(rng, 15)}</p></div>")
    body = rng.choice(WRAPPERS).format("\n".join(parts))
    around = [x.format(html.escape(sentence(rng, rng.randrange(5, 25)))) for x in rng.sample(AROUND, rng.randrange(1, 6))]
    cut = rng.randrange(len(around) + 1)
    head = rng.choice(["<html><head><title>T</title></head><body>", "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><body>", "<title>T</title>", "<head><title>T</title>"])
    return head + "".join(around[:cut]) + body + "".join(around[cut:]) + rng.choice(["", "</body></html>"]), "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(400))
def test_made_pages(seed):
    source, expected = page(random.Random(seed))
    assert main_text(source) == expected


@pytest.mark.parametrize("name", ["comment-content", "sidebar-content", "widget widget_text", "ad-content"])
def test_general_good_words_do_not_save_bad_ones(name):
    assert main_text(f"<div id=main><p>{ONE}</p><p>{TWO}</p></div><div class='{name}'><p>{ONE} {TWO}</p></div>") == f"{ONE}\n\n{TWO}"


def test_an_open_head_ends():
    for head in ("<head><title>T</title>", "<html><head><meta charset=utf-8><link rel=x>", "<head><script>1</script>\n"):
        assert main_text(f"{head}<body><article><p>{ONE}</p></article>") == ONE
        assert main_text(f"{head}<p>{ONE}</p><p>{TWO}</p>") == f"{ONE}\n\n{TWO}"


def test_the_article_own_header_stays():
    assert main_text(f"<header><p>Site</p></header><article><header><h1>Title</h1></header><p>{ONE}</p><p>{TWO}</p></article>") == f"Title\n\n{ONE}\n\n{TWO}"
    assert main_text(f"<article><div class='masthead'><h1>Title</h1></div><p>{ONE}</p><p>{TWO}</p></article>") == f"Title\n\n{ONE}\n\n{TWO}"


def test_sections_inside_an_article():
    inside = f"<article><p>{ONE}</p><p>{TWO}</p><section id='discussion'><p>{ONE}</p></section>%s</article>"
    expected = f"{ONE}\n\n{TWO}\n\n{ONE}"
    for dropped in (f"<section class='comments'><p>{TWO}</p></section>", f"<section id='comments'><p>{TWO}</p></section>", f"<section class='related-posts'><p>{TWO}</p></section>", f"<div id=respond><article class='comment'><p>{TWO}</p></article></div>"):
        assert main_text(inside % dropped) == expected


@pytest.mark.parametrize("name", ["<a \"", "<a x=\"", "<a x='>", "</span>", "<li>", "<dl><dt>a<dd>b", "<b><div></div>", "<header></header>", "<h2>a</h2>", "<table><tr><td>", "<p>some text, with commas", "<!--", "<", "<div class=ad>", "<script>"])
def test_time_grows_with_the_page(name):
    for before in ("", "<div>", "<b>", "<li><ul><b>"):
        took = []
        for n in (4000, 16_000):
            source, each = before * n + name * n, []
            for _ in range(3):
                start = time.perf_counter()
                main_text(source)
                each.append(time.perf_counter() - start)
            took.append(min(each))
        assert took[1] < 4**1.6 * max(took[0], 0.01)  # collecting garbage takes its share of deep trees; a quadratic step would be 16


def test_odd_rows_through_the_dataframe(spark):
    rows = [(1, "u", None, "a", 1), (2, None, "", "b", 2), (3, "u", f"<p>{ONE}", None, None), (3, "u", f"<p>{ONE}", None, None), (None, None, "text only, no tag", "c", 3), (4, "v", "<p>" + "word, " * 300_000, "d", 4)]
    schema = "page_id long, url string, html string, text string, n_chars long"
    found = html_extract.extract(spark.createDataFrame(rows, schema)).select("page.page_id", "page.text", F.col("text").alias("main"), "n_chars").collect()
    assert sorted((r.page_id or 0, len(r.main), r.n_chars) for r in found) == [(0, 17, 17), (1, 0, 0), (2, 0, 0), (3, len(ONE), len(ONE)), (3, len(ONE), len(ONE)), (4, 1_799_999, 1_799_999)]
    assert {r.text for r in found} == {"a", "b", None, "c", "d"}  # the pages' own column
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_the_articles_of_the_table(spark):
    """The table's pages have their text in an article element, in h1 and p elements; brute force cuts it out by those tags alone."""
    import re

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op5_html_text(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for k, source in pages.items():
        inner = source[source.index("<article>") + 9 : source.index("</article>")].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x))).strip() for x in re.split("</?(?:p|h1)>", inner)]
        assert got[k] == "\n\n".join(x for x in parts if x)
