"""Main text of pages: held-out labelled pages, the planted boilerplate of the tables, odd rows, and Viterbi against all paths."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from quillmill.llm import html_extract, queries
from quillmill.sources.html import read


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_held_out_pages(model):
    rng = random.Random(4711)
    kept = right = wanted = 0
    for _ in range(300):
        page, labels = html_extract.labelled_page(rng)
        blocks = read(page)[1]
        assert len(blocks) == len(labels)
        got = model.kept(html_extract.features(blocks), np.array([0, len(blocks)]))
        kept, wanted, right = kept + got.sum(), wanted + sum(labels), right + sum(g and w for g, w in zip(got, labels, strict=True))
    assert right / kept > 0.98 and right / wanted > 0.98


def article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    return "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", y)).split()) for y in re.split("<p>|</p>|<h1>|</h1>", inner)) if x)


def test_query_gives_the_article_of_every_page(spark, sf_dir):
    got = {r.page_id: r for r in queries.op12_html_extract(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article(p.html) and got[p.page_id].n_chars == len(article(p.html)) and got[p.page_id].url == p.url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain text", "plain text"), ("<p>Only a line.", "Only a line."), ("<article>Bare&nbsp;text<br>more</article><footer>x</footer>", "Bare text more"), ("<nav>menu</nav>", ""), ("<script>var a = '<p>no</p>'", ""),
        ('<div id="content"><div>One two three.</div><div>4 &lt; 5 &amp;c.</div></div><div class="sidebar"><p>A long sentence in a side bar, you see.</p></div>', "One two three.\n4 < 5 &c."),
        ('<main><article class="post"><header><h1>Title</h1></header><p>P1.</p><aside class="related"><a href=q>Rel</a></aside><p>P2</p><section id="comments"><h2>Comments</h2><article class="comment"><p>I think so, too, and more.</p></article></section></article></main>', "Title\nP1.\nP2"),
        ('<body class="has-sidebar"><div class="cookie-notice"><p>We use cookies on this page, as all do.</p></div><article><p>Text <b>of</b>\n the\tpage.<p style="display:none">unseen</p><form><label>Mail</label><button>Send</button></form></article>', "Text of the page."),
    ],
)
def test_other_layouts(model, page, text):
    assert html_extract.main_texts([page], model) == [text]


def test_odd_rows(spark, model):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "u", "<article>" + "<p>Ein Satz, der steht.</p>" * 20_000), (4, None, "")]
    docs = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(docs, batch_chars=50).collect()), key=repr)
    long = "\n".join(["Ein Satz, der steht."] * 20_000)
    assert got == sorted([(1, None, "", 0), (None, "u", "x", 1), (2, "u", "x", 1), (2, "u", "x", 1), (3, "u", long, len(long)), (4, None, "", 0)], key=repr)
    assert html_extract.extract(docs.limit(0)).count() == 0


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 7, 5)
        first, t = np.cumsum([0, *sizes]), rng.normal(size=(2, 2))
        e = rng.normal(size=first[-1])
        got = html_extract.viterbi(e, first, t)
        for a, b in itertools.pairwise(first):
            score = lambda path, a=a: sum(e[a + i] for i, y in enumerate(path) if y) + sum(t[x, y] for x, y in itertools.pairwise(path))
            assert tuple(got[a:b].astype(int)) == max(itertools.product((0, 1), repeat=b - a), key=score)
