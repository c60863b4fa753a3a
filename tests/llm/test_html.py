"""Main text: the cut against the classifier alone, hostile pages, and fitting."""

import random
import time

import numpy as np
import pytest

from graphloom.llm import html_extract as h


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def hard_page(r):
    """(html, wanted text): short and linked paragraphs in the article, prose outside it."""
    own, out = [], []
    for _ in range(r.randint(3, 8)):
        kind = r.choice(["long", "long", "short", "link", "item"])
        t = words(r, {"long": 40, "short": 2, "link": 5, "item": 3}[kind])
        own.append(t)
        out.append({"long": f"<p>{t}.</p>", "short": f"<p>{t}.</p>", "link": f"<p><a href=/x>{t}.</a></p>", "item": f"<ul><li>{t}.</li></ul>"}[kind])
        if r.random() < 0.3:
            out.append(f"<div class='ad-slot'><p>{words(r, 30)}.</p></div>")
    comments = "".join(f"<div><p>{words(r, 30)}.</p></div>" for _ in range(4))
    side = f"<aside><p>{words(r, 50)}.</p></aside><div><p>{words(r, 40)}.</p></div>"
    page = f"<html><body><nav><a href=/>{words(r, 2)}</a></nav><article>{''.join(out)}<section id=comments>{comments}</section></article>{side}<footer>{words(r, 12)}.</footer></body></html>"
    return page, " ".join(x + "." for x in own)


def test_the_cut_decides_labels_that_the_classifier_alone_gets_wrong():
    r = random.Random(1)
    pages = [hard_page(r) for _ in range(60)]
    changed = total = right = alone = 0
    for page, want in pages:
        found, up = h.blocks(page)
        by_cut = h.label(found, up, h.PRIOR)
        by_sign = [x > 0 for x in h.log_odds(found, h.PRIOR)]
        changed += sum(a != b for a, b in zip(by_cut, by_sign, strict=True))
        total += len(found)
        right += " ".join(b.text for b, k in zip(found, by_cut, strict=True) if k) == want
        alone += " ".join(b.text for b, k in zip(found, by_sign, strict=True) if k) == want
    assert right == len(pages) and alone < 0.1 * len(pages)
    assert changed > 0.2 * total


def test_unmarked_pages_are_smoothed_by_neighbours():
    prose = "<p>one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen.</p>"
    page = f"<div>{prose}<p>And so on</p>{prose}</div><div><a href=1>x</a></div><div><a href=2>y z</a></div>"
    found, up = h.blocks(page)
    odds = h.log_odds(found, h.PRIOR)
    assert h.main_text(page).count("And so on") == 1 and "y z" not in h.main_text(page)
    cut = h.minimum_cut([2.0, -0.5, 2.0], [(0, 1, 0.6), (1, 2, 0.6)])
    assert cut == [True, True, True] and len(odds) == len(found)


PROSE = [
    "The river rose over its banks in the night, and by morning the lower town stood under water.",
    "Boats went from house to house with bread and blankets, while the bells were rung every hour.",
    "Nobody was hurt, the mayor said, but it would take weeks until the last cellar was dry again.",
]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in PROSE)
FRAME = "<html><body><nav><a href=/>Home</a> <a href=/news>News</a></nav>{}<footer>All rights reserved.</footer></body></html>"
INNER = f"<article><h1>High water</h1>{PARAGRAPHS}</article>"
FRAMES = {
    "plain": INNER,
    "has a sidebar": f'<div class="layout has-sidebar">{INNER}<aside><p>Other things that one may also want to read at some time.</p></aside></div>',
    "with a menu": f'<div class="page with-nav">{INNER}</div>',
    "no adverts": f'<main class="content no-ads"><h1>High water</h1>{PARAGRAPHS}</main>',
    "legal news": INNER.replace("<article>", '<article class="legal-news">'),
    "comments enabled": INNER.replace("<article>", '<article class="post comments-enabled">'),
    "a paragraph of related work": INNER.replace(f"<p>{PROSE[1]}", f'<p class="related-work">{PROSE[1]}'),
    "a form around the page": f'<form id="aspnetForm" action="/">{INNER}</form>',
    "an unclosed button": f"<button class=burger>Menu{INNER}",
    "an unclosed drawing": f"<svg width=3>{INNER}",
    "a wrapper named by its sidebar": f'<div class="sidebar-left">{INNER}</div>',
    "a teaser beside it": f'{INNER}<div class="related"><article><h2>More</h2><p>A short teaser of another text.</p></article></div>',
    "comments as articles": f'{INNER}<section class="comments"><article><p>I have lived there for thirty years, and I have never seen anything like that before.</p></article></section>',
    "an advert in it": INNER.replace("</h1>", "</h1><div class='ad-slot'><p>Buy these boots now, they are waterproof and come in all the sizes that you want.</p></div>"),
    "a sign-up in it": INNER.replace("</h1>", "</h1><form class=signup><p>Give us your address and we will write to you every single week about all that happens.</p></form>"),
}


@pytest.mark.parametrize("name", sorted(FRAMES))
def test_articles_come_out_of_all_frames(name):
    assert h.main_text(FRAME.format(FRAMES[name])) == "High water " + " ".join(PROSE)


def test_words_on_wrappers_of_pages_without_an_article():
    for page in (f'<div class="sidebar-left"><h1>High water</h1>{PARAGRAPHS}</div>', f"<form><div><h1>High water</h1>{PARAGRAPHS}</div></form>", f"<select><div><h1>High water</h1>{PARAGRAPHS}</div>"):
        assert all(t in h.main_text(FRAME.format(page)) for t in PROSE)
    comments = "".join(f"<p>{t}</p>" for t in PROSE) * 4
    got = h.main_text(FRAME.format(f"<div><h1>High water</h1>{PARAGRAPHS}</div><div id=comments>{comments}</div>"))
    assert all(got.count(t) == 1 for t in PROSE)


def test_without_an_article_the_cut_beats_the_ties_alone():
    r = random.Random(11)
    right = alone = 0
    for _ in range(40):
        own = [words(r, r.choice([30, 30, 4])) + "." for _ in range(6)]
        own[0] = words(r, 30) + "."
        page = f"<ul><li><a href=/>{words(r, 2)}</a></li><li><a href=/x>{words(r, 3)}</a></li></ul><div>{''.join(f'<p>{t}</p>' for t in own)}</div><div class=sidebar><p>{words(r, 30)}.</p></div><div><a href=/y>{words(r, 3)}</a></div>"
        found, up = h.blocks(page)
        want = " ".join(own)
        right += " ".join(b.text for b, k in zip(found, h.label(found, up, h.PRIOR), strict=True) if k) == want
        alone += " ".join(b.text for b in found if b.tie > 0) == want
    assert right >= 36 and alone == 0


def test_unclosed_scripts_end_with_the_page():
    assert h.main_text(f"{INNER}<script>var x = 'one two three';") == "High water " + " ".join(PROSE)


def test_minimum_cut_with_ties_is_minimal():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 7)
        logit, tie = [r.uniform(-2, 2) for _ in range(n)], [r.choice([0.0, -3.0, 3.0]) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]

        def cost(side, logit=logit, tie=tie, edges=edges):
            own = sum((max(x, 0) + max(t, 0)) if not s else (max(-x, 0) + max(-t, 0)) for s, x, t in zip(side, logit, tie, strict=True))
            return own + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(h.minimum_cut(logit, edges, tie)) == pytest.approx(best)


@pytest.mark.parametrize("unit", ["<a", '<a "', "<!--", "<!", "</x>", "<div>x", "<video>", "<p><b>", "<a '\"x", '<a class="', "<li><b>", "<td><i>x", "&amp", "<script>"])
def test_work_grows_with_the_page(unit):
    page = unit * (400_000 // len(unit))
    began = time.time()
    h.main_text(page)
    assert time.time() - began < 5


def test_deep_containers_keep_their_distance():
    deep = "<div>" * 300
    close = "</div>" * 100
    found, up = h.blocks(f"{deep}<p>a</p>{close}<p>b</p><p>c</p>")
    edges = h.edges_of(found, up)
    assert [(i, j) for i, j, _ in edges] == [(1, 2)] and edges[0][2] == pytest.approx(0.6)


def test_fit_learns_what_marked_pages_show(spark):
    r = random.Random(5)
    rows = [(i, f"u{i}", f"<nav><a href=/>{words(r, 2)}</a></nav><article><h1>{words(r, 4)}</h1><p>{words(r, 30)}.</p></article><footer>© {words(r, 20)}.</footer>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    w = h.train(pages)
    assert not np.allclose(w, h.PRIOR)
    found, _ = h.blocks(rows[0][2])
    assert [x > 0 for x in h.log_odds(found, w)] == [False, True, True, False]
    assert np.array_equal(h.train(pages.limit(0)), h.PRIOR)
    assert h.extract(pages.limit(0)).count() == 0
    clash = pages.selectExpr("*", "1 as text", "2 as n_chars").where("page_id < 3")
    assert h.extract(clash).columns == ["page_id", "url", "text"] and h.extract(clash).count() == 3
