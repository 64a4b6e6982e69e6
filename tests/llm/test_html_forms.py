import pytest
from strandloom.llm.html_extract import main_text

STORY = "<article><h1>T</h1><p>Story</p></article>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>t</title><body>{STORY}</body></html>", "T\nStory"),
        ("<html><head><meta charset=utf-8><title>t</title><p>Story", "Story"),
        (f"<div class='content-sidebar-wrap'>{STORY}</div>", "T\nStory"),
        (f"<div id='has-sidebar'>{STORY}</div>", "T\nStory"),
        (f"<div class='sidebar'>{STORY}</div>", "T\nStory"),
        (f"<div class='related'><article>card</article></div>{STORY}", "T\nStory"),
        ("<article><p>Story<p class='share-price'>12.5</article>", "Story\n12.5"),
        ("<article><p>Story<div class=comments><article>reader</article></div></article>", "Story"),
        ("<aside><article>card</article></aside><p>Story", "Story"),
        ("<div class='widget'><p>Story</p></div>", "Story"),
        ("<nav>menu</nav>", ""),
        ("<div class='cookie-notice'>c</div><div class='ad-300x250'>a</div><div id=main-menu>m</div><div class=site-header>h</div><p>Story", "Story"),
    ],
)
def test_pages_that_lost_their_article(page, want):
    assert main_text(page, None, None) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h2 id='social-impact'>Social impact</h2><h2 id=comments>On comments</h2><p class='search-and-rescue'>At sea</p></article>", "Social impact\nOn comments\nAt sea"),
        ("<article><p>One <svg><text>no</text></svg>two <button>b</button>three</article>", "One two three"),
        ("<article><p>a &am<b>p;</b> b &amp;lt; c</article>", "a &amp; b &lt; c"),
        ("<div class='notice-period'>Three months</div><p id='related-work'>Earlier", "Three months\nEarlier"),
        ("<article><p>One<canvas>c<p>Two</p></canvas> three</article>", "One three"),
    ],
)
def test_names_and_cuts_inside_a_line(page, want):
    assert main_text(page, None, None) == want


def test_cost_grows_with_length():
    import time

    began = time.time()
    for page in ("<div>x" * 20_000, "<div><p>x" * 10_000 + "</div>" * 5_000, "</b>" * 50_000, "<b>y</i>" * 20_000, "&amp;" * 100_000, "<" * 100_000):
        assert main_text(page, None, None) is not None
    assert time.time() - began < 20


def test_template_against_brute_force(spark):
    """Classes, their nesting and the slot from occurrence vectors counted naively."""
    import random

    from strandloom.llm import html_extract as H

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    pages = []
    for k in range(12):
        rows = "".join(f"<li><p>{word()}</p></li>" for _ in range(rnd.randint(1, 5)))
        body = f"<div class=top><p>Welcome</p><p>{word()}</p></div><div class=body>{rows}<p>Ever the same</p><p>{' '.join(word() for _ in range(60))}</p></div><div class=low><i>x</i><p>Imprint</p><p>Ever the same</p></div>"
        pages.append((k, "http://h/", body if k else body.replace("<p>Imprint</p>", "")))
    vectors, facts = {}, {}
    for k, _, html in pages:
        page, blocks = H.parsed(html)
        for e in range(1, len(page.path)):
            vectors.setdefault(page.path[e], {}).setdefault(k, 0)
            vectors[page.path[e]][k] += 1
            facts[page.path[e]] = (page.path[page.parent[e]], page.depth[e], None)
        for e, text, cut, _ in blocks:
            h = H.text_hash(page.path[e], text)
            vectors.setdefault(h, {}).setdefault(k, 0)
            vectors[h][k] += 1
            facts[h] = (page.path[e], 0, text)
    often = {h: tuple(sorted(v.items())) for h, v in vectors.items() if len(v) >= max(H.LEAST_PAGES, len(pages) * H.LEAST_SHARE)}
    elements = {h for h in often if facts[h][1]}

    def has_above(h):
        up = facts[h][0]
        return up in elements and (often[up] == often[h] or has_above_of(up, often[h]))

    def has_above_of(h, vector):
        up = facts[h][0]
        return up in elements and (often[up] == vector or has_above_of(up, vector))

    valid = {v for v in set(often[h] for h in elements) if len({facts[h][0] for h in elements if often[h] == v and not has_above(h)}) == 1}
    want = {h for h in often if not facts[h][1] and often[h] in valid}
    ((got),) = H.templates(spark.createDataFrame([(h, k, x) for k, h, x in pages], "host string, page long, html string")).collect()
    assert set(got.texts) == want and {facts[h][2] for h in want} >= {"Welcome"}
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all("Welcome" not in t and "Imprint" not in t for t in out.values())
