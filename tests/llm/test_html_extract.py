"""HTML extraction: parsing, consistent decoding, held-out accuracy."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from gleanery.llm import html_extract as h


@pytest.fixture(scope="module")
def model():
    return h.default_model()


def whole(html):
    page = h.parse(html)
    return h.render(page, np.ones(len(page.tags), bool))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a\n  b<p>c<b>d</b>e</p>f", "a b\ncde\nf"),
        ("<p><b>t<br><p>u", "t\nu"),
        ("<p>x<br>y</p>", "x y"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("<script>var t='</p>';</script><style>p{}</style><p>k&eacute;&#233;&nbsp;&nbsp;z</p>", "kéé z"),
        ("<head><title>t</title><body>b", "b"),
        ("<div><!-- no --><span>a</span> <i>b</i></div></div></p>", "a b"),
        ("<p>a < b &lt; c</p>", "a < b < c"),
        ("<html><head><title>t</title><p>Body text here</p><p>more</p></html>", "Body text here\nmore"),
        ("<p>a</p><noscript><p>b</p><p>c", "a\nb\nc"),
        ("<p>a</p><noscript><p>b</p></noscript><p>c", "a\nc"),
        ('<script src="a.js"/>var x=1;</script><p>a</p>', "a"),
        ("<p>a<svg/>b</p>", "ab"),
        ("a\x00b", "a\x00b"),
    ],
)
def test_blocks(html, text):
    assert whole(html) == text


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = 7
        page = h.Page(["div"] * n, [-1, *(int(rng.integers(0, i)) for i in range(1, n))], [[]] * n, [])
        p = rng.random(n)
        best = max(
            (k for k in itertools.product([True, False], repeat=n) if k[0] and all(not k[i] or k[page.parents[i]] for i in range(1, n))),
            key=lambda k: sum(np.log(p[i] if k[i] else 1 - p[i]) for i in range(1, n)),
        )
        assert tuple(h.decode(page, p).tolist()) == best


def test_held_out_pages(model):
    right = words = missed = extra = 0
    for page, label in h.training_rows(4321, 150):
        got, want = h.render(page, h.decode(page, model.predict(h.features(page)))), h.render(page, label)
        right += got == want
        a, b = set(got.split("\n")), set(want.split("\n"))
        words, missed, extra = words + len(b), missed + len(b - a), extra + len(a - b)
    assert right >= 0.85 * 150
    assert missed <= 0.03 * words and extra <= 0.03 * words


# Pages written by hand, with their main text.
WRITTEN = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>River report</title><link rel=stylesheet href=s.css></head><body>
        <div id="top-bar"><a href=/>Home</a> <a href=/news>News</a> <a href=/about>About us</a></div>
        <div class="layout"><main><h1>The river rose two metres overnight</h1>
        <p>Residents of the lower town were woken shortly after three, when the first cellars filled with water and the old bridge was closed.</p>
        <p>The fire brigade counted forty flooded houses, but nobody was hurt. Pumps ran all morning, and a school served as a shelter.</p></main>
        <aside class="related"><h3>Related</h3><ul><li><a href=/1>Flood of 1998</a><li><a href=/2>Dyke plans</a></ul></aside></div>
        <footer><p>Copyright 2021 The Valley Courier. <a href=/imprint>Imprint</a></p></footer></body></html>""",
        ["The river rose two metres overnight", "Residents of the lower town were woken shortly after three, when the first cellars filled with water and the old bridge was closed.", "The fire brigade counted forty flooded houses, but nobody was hurt. Pumps ran all morning, and a school served as a shelter."],
    ),
    (
        """<title>Bread</title><nav><a href=a>Recipes</a><a href=b>Shop</a></nav><article class="post"><h1>A plain rye bread</h1>
        <p>Mix the flour with warm water and leave it to stand in the kitchen for a night, covered with a cloth.
        <p>Knead in salt, shape a loaf, and bake it for fifty minutes at a falling heat.<ul><li>500 g rye flour<li>400 ml water<li>10 g salt</ul></article>
        <section id="comments"><h3>2 comments</h3><div class="comment"><p>Worked very well, thank you for this one.</p></div><div class="comment"><p>Mine was far too wet, even after an hour.</p></div></section>""",
        ["A plain rye bread", "Mix the flour with warm water and leave it to stand in the kitchen for a night, covered with a cloth.", "Knead in salt, shape a loaf, and bake it for fifty minutes at a falling heat.", "500 g rye flour", "400 ml water", "10 g salt"],
    ),
    (
        """<html><body><div class="cookie-notice"><p>We use cookies to improve this site. By staying you agree to that.</p><button>OK</button></div>
        <header><div class="logo">Museum</div></header><div class="content"><h2>Opening of the new wing</h2>
        <p>On Saturday the museum opens a wing for the works on paper that have been kept in boxes for sixty years.</p>
        <div class="ad-banner"><p>Half price on all frames, only this week, only in our store.</p></div>
        <p>Visitors can see a hundred sheets at a time, and the rest in drawers on request.</p></div>
        <div class="footer">All rights reserved. Contact. Press.</div></body></html>""",
        ["Opening of the new wing", "On Saturday the museum opens a wing for the works on paper that have been kept in boxes for sixty years.", "Visitors can see a hundred sheets at a time, and the rest in drawers on request."],
    ),
]


def test_pages_written_by_hand(model):
    missed = extra = lines = 0
    for (html, want), got in zip(WRITTEN, h.extract([page for page, _ in WRITTEN], model), strict=True):
        blocks = got.split("\n")
        missed, extra, lines = missed + len(set(want) - set(blocks)), extra + len(set(blocks) - set(want)), lines + len(want)
    assert missed <= 0.1 * lines and extra <= 0.1 * lines


def test_deep_pages_take_time_in_proportion():
    page = h.parse("<div>" * 30_000 + "deep" + "<p>x" * 30_000)
    assert len(page.tags) == 60_001


def test_table(spark, model):
    page = (
        '<html><head><title>T</title></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">Buy now. Cheap things.</div>'
        "<article><h1>The head</h1><p><b>First words of it, long enough to be read.<br><p>And a second   paragraph &amp; more of the same.</p></article>"
        "<footer>&copy; nobody 2020</footer></body></html>"
    )
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(2)
    got = sorted((tuple(r) for r in h.extract_pages(df, model=model).collect()), key=str)
    text = "The head\nFirst words of it, long enough to be read.\nAnd a second paragraph & more of the same."
    assert [g for g in got if g[0] == 1] == [(1, "u", text, len(text))] * 2
    assert (2, None, "", 0) in got and (None, "v", "", 0) in got and len(got) == 5
    assert h.extract_pages(df.limit(0), model=model).count() == 0
