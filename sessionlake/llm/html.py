"""Operator 9. Main text of web pages by tree scoring.

A tolerant reading of the markup gives a tree of block elements. Each paragraph passes points (for
length and commas) to its container, half of them to the container's parent and a third to that one's. A container's points
are discounted by the share of its text that is link text. The best container is kept, with those of its siblings
that score well too or read like paragraphs, and within an article all that is no links; scripts, styles, forms, menus, notices, adverts, comments and the like never are.
A form, or a block whose class or id names boilerplate, is a mere wrapper and stays if it holds most of the page and all else would leave next to nothing.

Row by row, no shuffle; the reading takes time in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, put

MARKUP = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|</?([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)[^>]*+>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = set("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary address".split())
#: Elements whose content is not markup, elements that never hold article text, and elements without content.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNWANTED = RAW | set("nav footer aside form noscript template svg canvas select button object audio video map menu dialog head fieldset".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, if open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: What a class name or id says of an element's parts and not of its own role.
MODIFIER = re.compile(r"(?<![a-z])(?:has|with|no|without)[-_]+[a-z]+")
#: Parts of class names and ids.
BOILERPLATE = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar social share sharing related recommended popup modal overlay newsletter subscribe signup login search toolbar pagination pager widget widgets skip tags copyright".split())
COMMENTS = set("comment comments commentlist disqus reply replies respond".split())
CONTENT = set("article content main post entry story body text".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Elements of an article that a compound name with a word of BOILERPLATE in front doesn't drop.
SENTENCES = set("p h1 h2 h3 h4 h5 h6 blockquote li".split())
#: Outcomes of a look at an element: it stays, it goes unless it wraps the page's text, it goes.
STAYS, DOUBTFUL, GOES = 0, 1, 2
#: Points under which a page without article or main elements is no text in a wrapper but a form or a notice alone.
LEAST_WRAPPED = 8.0
HOLDS = {"article": 10.0, "main": 10.0, "section": 2.0, "div": 2.0, "ul": -3.0, "ol": -3.0, "table": -3.0, "dl": -3.0}


def outcome(tag: str, attributes: str, inside_article: bool) -> int:
    doubtful = tag in ("form", "fieldset") or (tag == "header" and not inside_article)
    if tag in UNWANTED and not doubtful:
        return GOES
    if not attributes or tag in ("html", "body", "article", "main"):
        return DOUBTFUL if doubtful else STAYS
    names: set[str] = set()
    roles: set[str] = set()  # last parts of names, as in cookie-notice, not copyright-law
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            own = MODIFIER.sub(" ", value)
            names |= set(re.split(r"[^a-z]+", own))
            roles |= {re.split(r"[^a-z]+", x.rstrip("-_0123456789"))[-1] for x in own.split()}
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES) or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return GOES
    if names & COMMENTS:
        return GOES
    if names & BOILERPLATE and not names & CONTENT and not (inside_article and tag in SENTENCES and not roles & BOILERPLATE):
        return DOUBTFUL if tag in BLOCKS else GOES
    return DOUBTFUL if doubtful else STAYS


class Page:
    """Nodes in page order: parent, tag, end of the subtree, dropped or not, doubtful or not; blocks of text by node."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.end, self.drop, self.doubt = [-1], ["#"], [0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack, self.open = [0], Counter()
        self.text: list[str] = []
        self.linked = self.links = self.breaks = self.articles = 0
        at = 0
        while at < len(html):
            m = MARKUP.search(html, at)
            if m is None:
                self.say(html[at:])
                break
            if m.start() > at:
                self.say(html[at : m.start()])
            at = m.end()
            tag = (m[1] or m[3] or "").lower()
            if not tag:
                continue
            if html[m.start() + 1] == "/":
                self.close(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = close.end() if close else len(html)
            else:
                self.start(tag, m[2] or "")
        self.flush()
        while self.stack:
            self.end[self.stack.pop()] = len(self.tag)

    def say(self, s: str) -> None:
        if "<" in s:  # a tag that the page's end cuts off
            s = re.sub(r"</?[a-zA-Z][^>]*$", "", s)
        s = unescape(s)
        if s.strip():
            self.breaks = 0
        if not self.drop[self.stack[-1]]:
            self.text.append(s)
            if self.links:
                self.linked += len(s.strip())

    def flush(self) -> None:
        t = " ".join("".join(self.text).split())
        if t:
            self.blocks.append((self.stack[-1], t, min(self.linked, len(t))))
        self.text, self.linked, self.breaks = [], 0, 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.text.append(" ")
            if self.breaks > 1:
                self.flush()
        elif tag == "a":
            self.links = 1
        if tag not in BLOCKS and tag not in UNWANTED and "=" not in attributes:
            return
        if tag not in BLOCKS and outcome(tag, attributes, False) == STAYS:
            return
        if tag in BLOCKS:
            self.flush()
            self.links = 0
        if tag in VOID:
            return
        if tag in BLOCKS and self.tag[self.stack[-1]] == "p":
            self.pop()
        for closed in CLOSES.get(tag, ()):
            if self.tag[self.stack[-1]] == closed:
                self.pop()
        up = self.stack[-1]
        self.parent.append(up)
        self.tag.append(tag)
        self.end.append(0)
        judged = outcome(tag, attributes, self.articles > 0)
        self.drop.append(self.drop[up] or judged == GOES)
        self.doubt.append(judged == DOUBTFUL)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1
        self.articles += tag in ("article", "main")

    def pop(self) -> None:
        self.flush()
        n = self.stack.pop()
        self.end[n] = len(self.tag)
        self.open[self.tag[n]] -= 1
        self.articles -= self.tag[n] in ("article", "main")

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if self.open[tag]:
            while self.tag[self.stack[-1]] != tag:
                self.pop()
            self.pop()
        elif tag in BLOCKS:
            self.flush()


def points(text: str, links: int) -> float:
    return ((len(text) >= 25) + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))


def settled(page: Page) -> list[tuple[int, str, int]]:
    """The blocks that no doubtful element takes away.

    Those that hold over half of the page's points form a chain. So many of it, from the outermost, are held for wrappers as it takes to
    reach an article or main element with half of the points, or a tenth of the points; none where the page has an article or main element beside them.
    """
    if not any(page.doubt):
        return page.blocks
    n = len(page.tag)
    held = [0.0] * n
    for node, text, links in page.blocks:
        held[node] += points(text, links)
    for i in range(n - 1, 0, -1):
        held[page.parent[i]] += held[i]
    level, off, chain, article = [0] * n, [False] * n, [], None
    around = [0] * n  # the article or main element that a node lies in
    for i in range(1, n):
        up = page.parent[i]
        around[i] = i if page.tag[i] in ("article", "main") else around[up]
        doubt = page.doubt[i] and not (around[i] and 10 * held[i] > 9 * held[around[i]])  # what is nearly all of an article is its text
        wrapper = doubt and 2 * held[i] > held[0]
        level[i], off[i] = level[up] + wrapper, off[up] or (doubt and not wrapper)
        if wrapper:
            chain.append(i)
        if page.tag[i] in ("article", "main") and not off[i] and not page.drop[i] and (level[i] == 0 or 2 * held[i] > held[0]):
            article = level[i] if article is None else min(article, level[i])
    wrappers = article or 0
    if article is None and held[0] >= LEAST_WRAPPED:
        free = [0.0] * (len(chain) + 1)
        for node, text, links in page.blocks:
            if not off[node]:
                free[level[node]] += points(text, links)
        wrappers = next((k for k, reached in enumerate(accumulate(free)) if 10 * reached >= held[0]), 0)
    return [b for b in page.blocks if not off[b[0]] and level[b[0]] <= wrappers]


def main_text(html: bytes | None) -> str:
    """The article's blocks, joined by newlines; a page without any text gives an empty one."""
    page = Page((html or b"").decode("utf-8", "replace"))
    n = len(page.tag)
    score, size, linked = [0.0] * n, [0] * n, [0] * n
    scored = [False] * n
    blocks = settled(page)
    for node, text, links in blocks:
        size[node] += len(text)
        linked[node] += links
        holder = page.parent[node] if page.tag[node] in PARAGRAPHS else node
        worth_of_text = points(text, links)
        for share in (1, 2, 3):
            if holder <= 0:
                break
            score[holder] += worth_of_text / share
            scored[holder] = True
            holder = page.parent[holder]
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]

    def worth(i: int) -> float:
        return (score[i] + (HOLDS.get(page.tag[i], 0.0) if score[i] > 0 else 0)) * (1 - linked[i] / size[i]) if size[i] else 0.0

    found = [i for i in range(1, n) if scored[i]]
    if not found:
        return "\n".join(t for _, t, links in blocks if links < len(t))
    best = max(found, key=lambda i: (worth(i), -i))
    keep = [(best, page.end[best])]
    top = page.parent[best]
    while top > 0 and page.tag[top] != "article":
        top = page.parent[top]
    if top <= 0:  # no article: the main element, or what the best container lies in
        top = page.parent[best]
        while top > 0 and page.tag[top] != "main":
            top = page.parent[top]
        top = top if top > 0 else page.parent[best]
    if page.tag[top] in ("body", "html", "#"):  # beside it there may be anything
        for i in range(top + 1, page.end[top]):
            if page.parent[i] == top and i != best and size[i]:
                dense = linked[i] / size[i]
                if (scored[i] and worth(i) >= max(5, 0.2 * worth(best))) or (page.tag[i] in PARAGRAPHS and size[i] > 80 and dense < 0.25):
                    keep.append((i, page.end[i]))
    else:  # all text beside the best container that is no links
        node, path = best, {}
        while node != top:
            path[page.parent[node]] = node
            node = page.parent[node]
        for i in range(top + 1, page.end[top]):
            if page.parent[i] in path and i != path[page.parent[i]] and size[i] and linked[i] / size[i] < 0.25:
                keep.append((i, page.end[i]))
    kept = {i for a, b in keep for i in range(a, b)}
    own = page.parent[best]
    return "\n".join(t for node, t, _ in blocks if node in kept or (node == own and page.tag[own] not in ("body", "html", "#")))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``text`` (replaces a column of that name, as does ``n_chars``) and ``n_chars``, its code points.

    A null, empty or text-free page gives an empty text; a page of any length is parsed whole, in time in proportion to it. Of containers with equal scores the first counts. Rows that
    repeat a page are treated alike. An empty table gives an empty result.
    """
    found = put(pages, text=per_row(lambda: main_text, "string", pa.string(), F.col(html)))
    return put(found, n_chars=F.length("text").cast("long"))
