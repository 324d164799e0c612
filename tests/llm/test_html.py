"""Line-block distribution against a plain version, and pages that it decides."""

import re
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from sparkwarden.llm import html_extract as H

PAGES = Path("/root/testdata/sf0.001/pages.parquet")


class Plain(HTMLParser):
    """Lines of well-formed pages of div, p, h2, a, article and class "ad": [text, linked, inside, heading, place]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.linked = [], "", 0
        self.stack, self.n = [("", 0), ("", 0)], 0
        self.skip = 0

    def flush(self):
        text = " ".join(self.text.split())
        names = [n for n, _ in self.stack]
        if text:
            self.lines.append([text, self.linked, "article" in names, "h2" in names, (self.stack[-1][0], self.stack[-2][1])])
        elif not self.skip:
            self.lines.append(["", 0, False, False, ()])
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.flush()
        ad = ("class", "ad") in attrs
        if ad:
            self.flush()
            if not self.skip:
                self.lines += [["", 0, False, False, ()] for _ in range(H.WINDOW)]
        self.n += 1
        self.stack.append((tag, self.n))
        self.skip += ad or self.skip > 0

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
            return
        self.flush()
        self.stack.pop()
        self.skip = max(0, self.skip - 1)

    link = False

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += len(data) * self.link


def brute(page):
    p = Plain()
    p.feed(page)
    p.flush()
    lines, w = p.lines, H.WINDOW
    free = lambda x: max(0, len(x[0]) - x[1])
    ahead = lambda f, i: sum(f[i : i + w])
    behind = lambda f, i: sum(f[max(0, i - w + 1) : i + 1])

    def runs(f, bar):
        out = []
        for i in range(len(f)):
            if f[i] and min(ahead(f, i), behind(f, i)) >= bar:
                if out and i - out[-1][-1] < w:
                    out[-1].append(i)
                else:
                    out.append([i])
        return [(r[0], r[-1] + 1) for r in out]

    peak = lambda f: max((min(ahead(f, i), behind(f, i)) for i in range(len(f))), default=0)

    def merged(rs):
        out = []
        for a, b in sorted(rs):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    if any(x[2] for x in lines):
        ins, outs = [free(x) if x[2] else 0 for x in lines], [0 if x[2] else free(x) for x in lines]
        total = sum(sum(outs[a:b]) for a, b in runs(outs, H.SURGE_CHARS))
        if 2 * (peak(outs) if total else 0) < peak(ins) and 2 * total < sum(ins):
            lines = [x if x[2] else ["", 0, False, False, ()] for x in lines]
    f = [free(x) for x in lines]
    rs = runs(f, max(1, min(H.SURGE_CHARS, peak(f))))
    if not rs:
        return ""
    if any(lines[i][2] for a, b in rs for i in range(a, b)):
        rs = merged(rs + runs([free(x) if x[2] else 0 for x in lines], 1))
    wide = []
    for a, b in rs:
        first, last, art, end, i = lines[a][4], lines[b - 1][4], lines[a][2], lines[b - 1][2], a - 1
        while i >= 0 and (not lines[i][0] and a - i <= w or lines[i][0] and (f[i] and (lines[i][3] and lines[i][2] == art or lines[i][4] == first) or lines[i][2] and art and ahead(f, i))):
            a, i = (i if lines[i][0] else a), i - 1
        i = b
        while i < len(lines) and (not lines[i][0] and i - b < w or lines[i][0] and (f[i] and lines[i][4] == last or lines[i][2] and end and behind(f, i))):
            b, i = (i + 1 if lines[i][0] else b), i + 1
        wide.append((a, b))
    rs = merged(wide)
    whole, before, keep = sum(f[rs[0][0] : rs[-1][1]]), 0, set()
    for k, (a, b) in enumerate(rs):
        if k:
            gap = [i for i in range(rs[k - 1][1], a) if lines[i][0]]
            if all(lines[i][2] for i in gap) or sum(lines[i][1] for i in gap) <= min(before, whole - before):
                keep.update(gap)
            before += sum(f[i] for i in gap)
        keep.update(range(a, b))
        before += sum(f[a:b])
    return "\n".join(lines[i][0] for i in sorted(keep) if lines[i][0])


def random_page(rng):
    def block(depth):
        kind = rng.choice(["p", "p", "div", "h2", "ad", "links", "nest", "empty"])
        words = " ".join("w" * int(rng.integers(1, 9)) for _ in range(int(rng.choice([1, 2, 4, 12, 60]))))
        if kind == "ad":
            return f'<div class="ad">{words}</div>'
        if kind == "links":
            return "".join(f"<p><a>{words[:20]}</a></p>" for _ in range(int(rng.integers(1, 7))))
        if kind == "nest" and depth < 3:
            return "<div>" + "".join(block(depth + 1) for _ in range(int(rng.integers(0, 4)))) + "</div>"
        if kind == "empty":
            return "<div></div>" * int(rng.integers(1, 4))
        tag = kind if kind in ("p", "h2") else "div"
        return f"<{tag}>{words} <a>{words[:9]}</a></{tag}>" if rng.random() < 0.2 else f"<{tag}>{words}</{tag}>"

    parts = [block(0) for _ in range(int(rng.integers(1, 9)))]
    if rng.random() < 0.6:
        a, b = sorted(int(x) for x in rng.integers(0, len(parts) + 1, 2))
        parts = [*parts[:a], "<article>", *parts[a:b], "</article>", *parts[b:]]
    return "".join(parts)


def test_main_text_equals_the_plain_version():
    rng = np.random.default_rng(7)
    kept = 0
    for _ in range(3000):
        page = random_page(rng)
        got = H.main_text(page)
        assert got == brute(page), page
        kept += bool(got)
    assert kept > 2000


def test_block_sums_equal_slices():
    x = [3, 0, 0, 41, 5, 0, 7, 7, 0]
    ahead, behind = H.block_sums(x)
    assert ahead.tolist() == [sum(x[i : i + H.WINDOW]) for i in range(9)]
    assert behind.tolist() == [sum(x[max(0, i - H.WINDOW + 1) : i + 1]) for i in range(9)]


def test_surge_and_dive_without_any_article():
    a, b = "word " * 60, "more " * 60
    got = H.main_text(f"<div>Home | About</div><p>{a}</p><p>{b}</p><div>Copyright</div>")
    assert got == f"{a.strip()}\n{b.strip()}"
    got = H.main_text(f"<div>Home</div><div>About</div><div><h2>Title</h2><p>{a}</p><p>Short.</p><p>{b}</p><p>End.</p></div><div>Imprint</div>")
    assert got == f"Title\n{a.strip()}\nShort.\n{b.strip()}\nEnd."


def test_the_distribution_decides_with_articles_too():
    a = "word " * 60
    teasers = "".join(f"<article><h2>Card {k}</h2></article>" for k in range(4))
    assert H.main_text(f"{teasers}<div><p>{a}</p><p>{a}</p></div>") == f"{a.strip()}\n{a.strip()}"
    links = "".join(f"<div><a href=x>Other story {k}</a></div>" for k in range(8))
    assert H.main_text(f"<article><p>{a}</p><div></div><div></div><div>{links}</div></article>") == a.strip()


@pytest.mark.skipif(not PAGES.exists(), reason="needs the given tables")
def test_given_pages_need_no_article_element():
    pages = pd.read_parquet(PAGES)["html"].tolist()
    assert all("<article>" in p for p in pages)
    assert all(H.main_text(re.sub("</?article>", "", p)) == H.main_text(p) != "" for p in pages)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>Let <math><mi>x</mi></math> be <svg><text>y</text></svg> one <object>z</object></p></article>", "Let x be y one z"),
        ("<article><p>Press <button>Save</button> now</p></article>", "Press Save now"),
        (f'<article><p>One</p><img alt="{"a>" * 9000}"><p>Two</p></article>', "One\nTwo"),
        ("<article><p>One</p><!-- never closed <p>Two</p></article>", "One\nTwo"),
        ("<article><p>One</p><!-- <p>no</p> --><p>Two</p></article>", "One\nTwo"),
        ("<article><p title=it's>One</p><p>It's two</p></article>", "One\nIt's two"),
        ("<article><p>a <b and c<p>Two</p></article>", "a <b and c\nTwo"),
        ('<article><p class="x>One</p><p>Two</p></article>', "One\nTwo"),
        ("<!---->x", "x"),
    ],
)
def test_markup_that_is_text_and_text_that_is_markup(page, text):
    assert H.main_text(page) == text


def test_broken_markup_stays_linear():
    import time

    for page in ("<a '<b\"" * 60_000, "<p x='" * 60_000, "<" * 400_000, "<!--" * 100_000, "<b>" * 50_000 + "x", "<div>" * 50_000 + "x"):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 10, page[:20]
