"""Main-text extraction: the cut against brute force, whole pages against pages whose texts are known."""

import itertools
import time
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b> text<br>goes on.<p>Second &eacute;<aside>Related links</aside><ul><li>point one</ul><section class="comments"><p>reader says</p></section></article>
<form><p>Search</p></form><footer>&copy; us</footer></body></html>"""


@pytest.fixture(scope="module")
def weights():
    return extract.fit(*extract.lessons())


def test_pages_are_extracted(spark, weights):
    story = "long text. " * 5000
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>bare text without an end"), (5, "u", f"<article><p>{story}"), (6, "u", PAGE), (6, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "h": F.lit(2), "x": F.lit(3)})
    out = extract.extract(df).collect()
    found = {r.page_id: r for r in out}
    assert len(out) == 7 and found[1].text == "Title & more\nFirst bold text goes on.\nSecond é\npoint one" and found[1].n_chars == len(found[1].text)
    assert found[2].text == found[3].text == "" and found[5].text == story.strip() and found[None].text == "bare text without an end"
    assert [r.text for r in out if r.page_id == 6] == [found[1].text] * 2
    assert extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><header><h1>My title</h1><p>In short, a summary.</p></header><p>The text.</p></article>", "My title\nIn short, a summary.\nThe text."),
        ('<main><p>Some text stands here.</p><div class="related-work"><p>Others wrote about it as well.</p></div><div class="social-history"><p>It is a long story.</p></div></main>', "Some text stands here.\nOthers wrote about it as well.\nIt is a long story."),
        ('<article><p class="x>broken</p><p class="y">whole</p></article>', "broken\nwhole"),
        ("<article><p title='a > b'>quoted</p>1 < 2 and 3 > 2</article>", "quoted\n1 < 2 and 3 > 2"),
        ('<article><p>Text of it all.</p><section id="comments"><p>What a fine story this is, I liked it.</p></section></article><footer>&copy; me</footer>', "Text of it all."),
        ('<div class="cookieBanner"><p>We use cookies, as everybody does, to make things better.</p></div><article><p>The one text.</p></article>', "The one text."),
    ],
)
def test_what_stays_of_a_page(weights, page, text):
    assert extract.main_text(page, weights) == text


def test_texts_of_made_up_pages(weights):
    """On lessons of another seed nearly all blocks get the label that they were made with, and the text is that of the labels."""
    rng, right, kept, all_ = Random(77), 0, 0, 0
    for _ in range(150):
        page = extract.lesson(rng)
        found = extract.blocks(page)
        wanted = "\n".join(b.text for b in found if b.text[0] == "c")
        text = extract.main_text(page, weights)
        right += text == wanted
        all_ += len(wanted.split("\n"))
        kept += sum(line[:1] == "c" for line in text.split("\n"))
    assert right > 120 and kept > 0.98 * all_


def test_without_weights_nothing_is_told():
    assert extract.main_text(PAGE, np.zeros(extract.N_FEATURES)) == ""


@pytest.mark.parametrize("most", [3, 9])
def test_cuts_are_minimal(most):
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        c, b = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(int(rng.integers(n)), int(rng.integers(n)), float(rng.random())) for _ in range(int(rng.integers(0, n * most)))]
        cost = lambda l: sum(c[i] if l[i] else b[i] for i in range(n)) + sum(w for i, j, w in edges if l[i] != l[j])  # noqa: B023, E731, E741
        assert cost(extract.minimum_cut(c, b, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_of_equal_cuts_the_smallest():
    assert extract.minimum_cut([1.0, 1.0], [1.0, 1.0], [(0, 1, 1.0)]) == [False, False]


@pytest.mark.parametrize("page", ["<a " * 100_000, "<p>" + "<a " * 100_000 + ">x", '<p class="x>' * 100_000, "".join(f"<div>w{i % 7}<a>b</a></div>" for i in range(100_000)), "<i><div>" + "<b>x" * 50_000 + "</section></i>" * 50_000], ids=["open", "one", "quotes", "blocks", "odd"])
def test_long_pages_take_linear_time(weights, page):
    began = time.time()
    extract.main_text(page, weights)
    assert time.time() - began < 30


STORY = "<article><h1>Title of it</h1><p>The council met on Monday and voted for the bridge, which will be built next year.</p><p>Work begins in spring, said the mayor, and ends a year later.</p></article>"
TOLD = "Title of it\nThe council met on Monday and voted for the bridge, which will be built next year.\nWork begins in spring, said the mayor, and ends a year later."
PAGES = [
    STORY + '<section id="comments"><article class="comment"><p>I do not like this bridge at all, it costs too much money for the town.</p></article></section>',
    '<div id="onetrust-banner">We value your privacy. Accept all</div>' + STORY,
    '<div class="adsbygoogle">Buy the best shoes of the town today, they are cheap.</div>' + STORY,
    STORY + '<div class="dfp-slot">Buy the best shoes of the town today, they are cheap.</div>',
    STORY + '<div class="kommentare"><p>Ich mag diese neue Brücke gar nicht, sie kostet viel zu viel Geld.</p></div>',
    STORY + "<div><h3>3 comments</h3><div>I do not like this bridge at all, it costs too much money.</div><div>I do like it, and so will all of you.</div></div>",
    STORY.replace("<p>Work", "<p hidden>Never shown to anybody who reads this page.</p><p style='color:red; display: none'>Nor this.</p><p class=hidden data-x='hidden'>Work"),
]


@pytest.mark.parametrize("page", PAGES)
def test_what_is_outside_the_main_text_goes(page):
    w = extract.fit(*extract.lessons())
    assert extract.main_text(page, w) == TOLD
