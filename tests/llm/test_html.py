"""Names, articles, broken pages and time of the extraction; the ratios against plain loops."""

import math
import random
import time

import pytest

from hamsieve.llm.html import blocks_of, content_paths, main_text

ARTICLE = (
    "<article><p>First, with much running text, and signs; enough of them, truly.</p><p>Second paragraph, which goes on, and on, with commas.</p>"
    "{}<p>Third one, again with some text, and more of it.</p></article>"
)


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<h2 id="side-effects">Side effects</h2>', "Side effects"),
        ('<p class="notice-period">Notice period, of three months.</p>', "Notice period, of three months."),
        ('<section id="related_work"><p>Related work, much of it, has been done before.</p></section>', "Related work, much of it, has been done before."),
        ('<section id="search"><p>We search, and search on, in trees.</p></section>', "We search, and search on, in trees."),
        ('<div data-id="search-7"><p>Item seven, here.</p></div>', "Item seven, here."),
        ('<video src="x"><p>After a video that never ends, text.</p>', "After a video that never ends, text."),
        ('<video src="x">No video here.</video>', None),
        ('<div class="ad">Buy, now!</div>', None),
        ('<div class="cookie-notice">We use cookies.</div>', None),
        ('<div class="comments"><p>I do not agree, at all, with this, and that, and much else besides.</p></div>', None),
        ('<article class="comment"><p>Nor do I, with any of it, by the way, as I have said before.</p></article>', None),
        ('<div role="search">Find it, here.</div>', None),
        ("<form><p>Sign up, please.</p></form>", None),
    ],
)
def test_parts_of_an_article(part, kept):
    middle = main_text("<nav>a</nav>" + ARTICLE.format(part) + "<footer>b</footer>").split("\n\n")[2:-1]
    assert middle == ([kept] if kept else [])


def test_all_articles_that_reach_the_cut():
    short = "<article><p>Another, smaller article, with its own text, too.</p></article>"
    teaser = '<article><h3><a href="x">A title</a></h3><p>More</p></article>'
    found = main_text("<body><nav>a b</nav>" + ARTICLE.format("") + short + teaser + "</body>").split("\n\n")
    assert len(found) == 4 and found[-1].startswith("Another")


def test_names_beside_the_content_of_a_page_without_an_article():
    prose = "<p>Much running text, with signs; and more, and more of it, to the end.</p>" * 4
    page = '<div id="site-menu">Shop, help.</div><div id="main"><section id="side-effects">{0}</section></div><div class="left-sidebar">{0}</div><div id="comments">{0}</div>'
    assert len(main_text(page.format(prose)).split("\n\n")) == 4


def test_broken_tags():
    assert main_text('<p>a <a "b c') == 'a <a "b c'
    assert main_text('<p title="x > y">one, two</p>') == "one, two"
    assert main_text('<p title="x>one, two</p>') == "one, two"
    assert main_text("<article><p>one<!-- open") == "one"
    assert main_text("<article><p>one</p><title>two") == "one\n\ntwo"
    assert main_text("<article><table><tr><td>a, b<td>c, d<tr><td>e, f</table></article>") == "a, b\n\nc, d\n\ne, f"


@pytest.mark.parametrize(
    "piece", ['<a "', "<div>x", '<a "><a" ', "<b>x</i>", "<title>", "<video>", "<p>x</div>", "<td>x<table>", "<a '\">", "<article>x", "<li><p><ul>", '<div class="ad">x']
)
def test_time_grows_with_the_page_only(piece):
    def seconds(n):
        start = time.process_time()
        main_text(piece * n)
        main_text(piece * n + "</video></article>'\">")
        return time.process_time() - start

    seconds(200)
    assert seconds(16_000) < 0.2 + 16 * max(seconds(2_000), 0.02)


def plain_paths(page):
    """Sums per path, smoothing, product and cut, by loops over blocks and distances."""
    blocks = [(b.path, len(b.text) - min(b.linked, len(b.text)), sum(c in ".,;:!?…。，、！？" for c in b.text)) for b in blocks_of(page)]

    def ratio(k, what):
        same = [b for b in blocks if b[0] == blocks[k][0]]
        return sum(b[what] if what == 1 or b[1] else 0 for b in same) / len(same)

    def smooth(values, k):
        near = [j for j in range(k - 2, k + 3) if 0 <= j < len(values)]
        weights = [math.exp(-0.5 * (j - k) ** 2) for j in near]
        return sum(w * values[j] for w, j in zip(weights, near, strict=True)) / sum(weights)

    texts, signs = ([ratio(k, what) for k in range(len(blocks))] for what in (1, 2))
    fused = [smooth(texts, k) * (1 + smooth(signs, k)) for k in range(len(blocks))]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    scores = {}
    for p in {b[0] for b in blocks}:
        own = [f for f, b in zip(fused, blocks, strict=True) if b[0] == p]
        scores[p] = sum(own) / len(own)
    cut = min(deviation, max(scores.values()))
    return {p for p, s in scores.items() if s >= cut - 1e-12 and any(b[0] == p and b[1] for b in blocks)}, cut


def test_ratios_equal_plain_loops():
    r = random.Random(4)
    words = ["one", "two,", "three.", "four", "<a href='x'>link</a>", "<b>bold!</b>"]
    for _ in range(60):
        page = ""
        for _ in range(r.randint(1, 40)):
            tag = r.choice(["p", "div", "li", "h2", "section", "td"])
            page += f"<{tag}>" + " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 40]))) + r.choice([f"</{tag}>", ""])
        blocks = blocks_of(page)
        if blocks:
            paths, cut = content_paths(blocks)
            want, want_cut = plain_paths(page)
            assert paths == want and cut == pytest.approx(want_cut)
