"""Main text of web pages by line-block distribution.

Markup is stripped into lines: every edge of a block element ends a line, so
nested or empty blocks leave blank lines, and elements that are boilerplate by
name, role or class leave ``WINDOW`` blank lines.  The lengths of link-free text
are summed over sliding windows of ``WINDOW`` lines, once from each line on and
once up to it.  The text surges at the first line where both sums reach
``SURGE_CHARS`` and dives after the last one, and all between is kept; a short
line beside a dense one has one small sum, so menus and imprints at the edges
fall out.  Tags help at the edges only: headings just before a surge and lines
of its edge's own kind and parent belong to it, and inside ``article`` and
``main`` a surge lasts until the sums are zero.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Both sums of a line must reach so many characters for it to begin or end the main body.
SURGE_CHARS = 40

OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: The rest of a tag; a quoted value begins after an equals sign and may be of any length.
REST = re.compile(r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
RAW = {n: re.compile(rf"</{n}\b[^>]*+>", re.I) for n in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "select")}
#: Text in these counts as linked.
LINKED = frozenset(("a", "button"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("nav footer aside form head menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
# Words in a class or id that mark boilerplate (fixed values).
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promotion promoted related recommended replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table div section article main body td th blockquote".split())
ATTR = re.compile(r"""([a-zA-Z:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Line(NamedTuple):
    """A line of a page: blank lines have no text, ``linked`` counts its characters in links."""

    text: str = ""
    linked: int = 0
    inside: bool = False  # an article or main element
    heading: bool = False
    place: tuple = ()  # name of the block element, number of its parent

    @property
    def free(self) -> int:
        return max(0, len(self.text) - self.linked)


BLANK = Line()


def _boilerplate(name: str, attrs: str, inside: bool) -> bool:
    if name in DROP or (name == "header" and not inside):
        return True
    if not attrs.strip() or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if (key == "role" and value.strip() in ROLES) or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"""=\s*(?:"[^"]*"|'[^']*'|\S+)""", "", attrs)) is not None


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order, blank ones included.

    A comment that is never closed ends at the next ``>``; what opens a tag and
    never closes it is text.
    """
    out: list[Line] = []
    text: list[str] = []
    linked, dropped, links, inside, heads, opened = 0, 0, 0, 0, 0, 0
    stack: list[tuple[str, bool]] = []
    count: Counter = Counter()  # open elements by name
    blocks: list[tuple[str, int]] = [("", 0), ("", 0)]
    end = len(page)

    def close() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split()) if text else ""
        if line:
            out.append(Line(line, linked, inside > 0, heads > 0, (blocks[-1][0], blocks[-2][1])))
        elif not dropped:
            out.append(BLANK)
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, links, inside, heads
        name, drop = stack.pop()
        count[name] -= 1
        if name in BLOCK:
            close()
            blocks.pop()
        dropped -= drop
        links -= name in LINKED
        heads -= name in HEADINGS
        inside -= name in ("article", "main") and not drop

    def add(a: int, b: int) -> None:
        nonlocal linked
        if a < b and not dropped:
            text.append(page[a:b])
            if links:
                linked += b - a

    at = 0
    while at < end:
        m = OPEN.search(page, at)
        if not m:
            add(at, end)
            break
        add(at, m.start())
        if m[1]:
            stop = page.find("-->", m.end() - 2)
            at = stop + 3 if stop >= 0 else (page.find(">", m.end()) + 1 or end)
            continue
        rest = REST.match(page, m.end())
        at = rest.end()
        if page[at : at + 1] != ">":
            add(m.start(), at)
            continue
        at += 1
        if not m[3]:
            continue
        name, attrs = m[3].lower(), rest[0]
        if m[2]:
            if count[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name in BLOCK:
                close()
            continue
        if name in RAW:
            e = RAW[name].search(page, at)
            at = e.end() if e else (end if name in ("script", "style", "textarea", "title") else at)
            continue
        if name in VOID:
            if name == "hr":
                close()
            elif name == "br" and not dropped:
                text.append(" ")
            continue
        if name in ("body", "article", "main"):
            # an unclosed head or menu ends where the page's body begins; a dropped card inside a sidebar stays dropped
            while stack and stack[-1][1] and (name == "body" or stack[-1][0] in ("nav", "head", "header")):
                pop()
        ends = CLOSES.get(name, ("p",) if name in BLOCK else ())
        if any(count[e] for e in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in HOLDS:
                    break
        if name in BLOCK:
            close()
        drop = _boilerplate(name, attrs, inside > 0)
        if attrs.endswith("/") and name not in BLOCK:
            continue
        if drop:
            close()
            if not dropped:
                out.extend([BLANK] * WINDOW)
        stack.append((name, drop))
        count[name] += 1
        if name in BLOCK:
            opened += 1
            blocks.append((name, opened))
        dropped += drop
        links += name in LINKED
        heads += name in HEADINGS
        inside += name in ("article", "main") and not drop
    while stack:
        pop()
    close()
    return out


def block_sums(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the ``WINDOW`` lines from each line on, and over those up to it."""
    total = np.concatenate(([0], np.cumsum(np.asarray(lengths, "int64"))))
    at = np.arange(len(lengths))
    return total[np.minimum(at + WINDOW, len(lengths))] - total[at], total[at + 1] - total[np.maximum(at + 1 - WINDOW, 0)]


def surges(lengths: list[int], bar: int) -> list[tuple[int, int]]:
    """``(first, end)`` of each stretch from a surge to a dive: lines both of whose sums reach ``bar``, blanks at the ends off."""
    ahead, behind = block_sums(lengths)
    high = (np.minimum(ahead, behind) >= bar) & (np.asarray(lengths) > 0)
    # a blank or linked line between two high ones of one window splits nothing
    at = np.flatnonzero(high)
    cuts = np.flatnonzero(np.diff(at) >= WINDOW)
    return [(int(a), int(b) + 1) for a, b in zip(at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))])] if len(at) else []


def _peak(lengths: list[int]) -> int:
    return int(np.minimum(*block_sums(lengths)).max()) if lengths else 0


def _bounded(lines: list[Line]) -> list[Line]:
    """The lines, with those outside ``article`` and ``main`` blank where the text there is by far thinner.

    That is, where neither the densest line outside nor the text of the surges
    there reaches half of what stands inside.
    """
    inside, outside = [x.free * x.inside for x in lines], [x.free * (not x.inside) for x in lines]
    total = sum(sum(outside[a:b]) for a, b in surges(outside, SURGE_CHARS))
    if 2 * (_peak(outside) if total else 0) < _peak(inside) and 2 * total < sum(inside):
        return [x if x.inside else BLANK for x in lines]
    return lines


def _edges(lines: list[Line], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches with their edges moved out: over headings just before and lines that stand as the
    edge itself does, and inside an article until the sums are zero."""
    lengths = [x.free for x in lines]
    ahead, behind = block_sums(lengths)
    out = []
    for a, b in runs:
        first, last = lines[a], lines[b - 1]
        for i in range(a - 1, -1, -1):
            x = lines[i]
            if x.text and (x.free and (x.heading and x.inside == first.inside or x.place == first.place) or x.inside and first.inside and ahead[i]):
                a = i
            elif x.text or a - i > WINDOW:
                break
        for i in range(b, len(lines)):
            x = lines[i]
            if x.text and (x.free and x.place == last.place or x.inside and last.inside and behind[i]):
                b = i + 1
            elif x.text or i - b >= WINDOW:
                break
        out.append((a, b))
    return out


def _bridged(lines: list[Line], runs: list[tuple[int, int]]) -> list[int]:
    """Lines from the first surge to the last dive.

    A stretch between two of them is kept inside an article, or where the text
    on both sides outweighs its links; a menu between a slogan and the text is not.
    """
    kept, before, at = [], 0, runs[0][0]
    whole = sum(x.free for x in lines[runs[0][0] : runs[-1][1]])
    for a, b in runs:
        between = [x for x in lines[at:a] if x.text]
        if all(x.inside for x in between) or sum(x.linked for x in between) <= min(before, whole - before):
            kept.extend(range(at, a))
        kept.extend(range(max(a, at), b))
        before, at = before + sum(x.free for x in lines[at:b]), max(at, b)
    return kept


def main_text(page: str | None) -> str:
    """Kept lines joined by a line break; empty where none is kept.

    Where no line reaches ``SURGE_CHARS``, the bar is the page's largest sum.
    Lines of an article that has a surge need any sum, not ``SURGE_CHARS``.
    """
    lines = lines_of(page) if page else []
    if any(x.inside for x in lines):
        lines = _bounded(lines)
    lengths = [x.free for x in lines]
    bar = max(1, min(SURGE_CHARS, _peak(lengths)))
    runs = surges(lengths, bar)
    if not runs:
        return ""
    if any(x.inside for a, b in runs for x in lines[a:b]):
        inside = surges([x.free * x.inside for x in lines], 1)
        runs = _merged(runs + inside)
    kept = _bridged(lines, _merged(_edges(lines, runs)))
    return "\n".join(lines[i].text for i in kept if lines[i].text)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """``key, text, n_chars`` of every row; null and empty pages give an empty text.

    Pages of any length are read whole, repeated rows give equal rows, and an
    empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) if isinstance(h, str) else "" for h in pdf["_html"]]
            yield pd.DataFrame({key: pdf[key].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(key).cast("long"), F.col("url").cast("string"), F.col(source).cast("string").alias("_html"))
    return rows.mapInPandas(run, f"{key} long, url string, text string, n_chars long")
