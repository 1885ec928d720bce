"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is read once as a sequence of tags and words. Every token gets a weight: tags cost, words pay, and
how much a word pays depends on the elements it stands in (navigation, footer, form, advert, comment ...).
The weights are log odds learned from labelled pages (``LABELLED_PAGES``). A linear scan (Kadane) finds the
contiguous region of the greatest sum; boxes inside the region that the same weights call boilerplate are
left out, the rest becomes text.

Defined cases: null or empty html, and pages without a word, give empty text; unclosed, stray and upper-case
tags are tolerated; an unclosed comment, script or style runs to the end of the page; the first of equal
regions wins; every repeated row gets the same answer; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import map_batches, table

#: How a comment, a tag or a declaration begins.
HEAD = re.compile(r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)|[!?])", re.I)
QUOTE_OR_END = re.compile(r"[\"'>]")
#: Elements whose content is not markup, with what closes them.
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style template noscript textarea svg iframe title".split()}
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose words are judged by the element itself.
BOXES = frozenset("nav header footer aside form menu dialog article main head button select figcaption".split())
#: Elements whose class, id or role decides what box they are.
CARRIERS = frozenset("div section ul ol p span table header footer aside nav article main".split())
#: Kinds of boxes by the words in a class, id or role. Fixed values.
HINTS = (
    ("ad", frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion".split())),
    ("comments", frozenset("comment comments respond reply replies disqus discussion".split())),
    ("nav", frozenset("nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc skip".split())),
    ("notice", frozenset("cookie cookies consent gdpr notice popup modal alert newsletter subscribe subscription signup".split())),
    ("aside", frozenset("sidebar aside related widget complementary share social recommended trending".split())),
    ("footer", frozenset("footer copyright contentinfo legal".split())),
    ("header", frozenset("masthead banner-top site-header topbar".split())),
)

#: Labelled pages: [[ and ]] stand around the main text.
LABELLED_PAGES = (
    '<html><head><title>One</title></head><body><header><h1>Daily Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="ad">Buy our new shoes now</div><article>[[<h1>Rain is coming</h1><p>The river rose by a metre in the night and the <b>old bridge</b> was closed to traffic.</p><p>Nobody was hurt.</p>]]</article><footer>&copy; Daily Site. All rights reserved.</footer></body></html>',
    '<body><div id="menu"><a href="a">Shop</a> <a href="b">Blog</a> <a href="c">About us</a></div><main>[[<h2>How to prune a pear tree</h2><p>Wait until the leaves have gone, then take out the dead wood first.</p><ul><li>Keep the cuts clean and small</li><li>Leave the fruit spurs alone</li></ul><blockquote>Less is more, as my father said every winter.</blockquote>]]</main><aside><h3>Related</h3><ul><li><a href="x">Ten apple recipes</a></li></ul></aside><div class="comments"><p>Great post, thank you!</p><p>I lost a tree doing this, be careful.</p></div></body>',
    '<body><div class="cookie notice">We use cookies to make this site better. <button>Accept</button></div><div class="nav"><a href="1">World</a><a href="2">Sport</a></div><div class="content">[[<h1>Election results are in</h1><p>Turnout reached a record, the office said on Monday, after a long campaign.</p><table><tr><td>North</td><td>51 percent of votes</td></tr></table><p>A second round follows in May.</p>]]</div><form><label>Email</label><input name="e"><button>Subscribe to our newsletter</button></form><footer><p>Contact us, imprint and terms of use</p></footer></body>',
    '<body><header class="site-header"><p>The best recipes since 1990</p></header><div class="sidebar"><p>Follow us on every network there is</p></div><article>[[<h1>Onion soup</h1><p>Slice the onions thin and cook them slowly in butter for an hour.</p><pre>4 onions, 50 g butter, 1 l stock</pre><p>Serve hot with bread.</p>]]<div class="share"><a href="t">Tweet</a><a href="f">Share</a></div></article><section id="comments"><h2>Comments</h2><p>My children loved it very much.</p></section><footer>Printed in the kitchen</footer></body>',
    '<body><nav><p>You are here: home, travel</p></nav><main><article>[[<h1>Two days in the hills</h1><p>We set out before dawn and saw nobody until the pass.</p><p>The hut was full, so we slept outside under the stars.<br>It was cold.</p>]]</article></main><div class="related"><p>More from travel: the coast by bike</p></div><form><p>Search this site</p></form><div class="advert"><p>Cheap flights to the hills</p></div><footer><ul><li><a href="i">Imprint</a></li></ul></footer></body>',
)


class Ends:
    """Where tags end. Every quote and angle bracket is looked at once, so many unclosed tags take linear time."""

    def __init__(self, source: str):
        self.source, self.known, self.last = source, {}, None
        self.low, self.found = 1, -1  # from ``low`` on, the next quote or bracket is at ``found``

    def special(self, at: int) -> int:
        if not self.low <= at <= self.found:
            m = QUOTE_OR_END.search(self.source, at)
            self.low, self.found = at, m.start() if m else len(self.source)
        return self.found

    def plain(self, at: int) -> int:
        """The place behind the next closing bracket; -1 if there is none."""
        if self.last is None:
            self.last = self.source.rfind(">")
        return self.source.find(">", at) + 1 if at <= self.last else -1

    def of(self, at: int) -> int:
        """The place behind the tag whose attributes begin at ``at``; -1 if it is never closed."""
        passed, end = [], -1
        while (p := self.special(at)) < len(self.source):
            if p in self.known:
                end = self.known[p]
                break
            passed.append(p)
            if self.source[p] == ">":
                end = p + 1
                break
            if (q := self.source.find(self.source[p], p + 1)) < 0:
                break
            at = q + 1
        self.known.update(dict.fromkeys(passed, end))
        return end


class Markup(NamedTuple):
    """One comment, raw-text element, tag or declaration."""

    start: int
    end: int
    kind: str
    tag: str = ""
    closing: bool = False
    attrs: str = ""


def markup(source: str) -> Iterator[Markup]:
    """The markup of a page in order; what lies between is text, and so is a bracket that opens nothing."""
    ends, at, size = Ends(source), 0, len(source)
    while (at := source.find("<", at)) >= 0:
        m = HEAD.match(source, at)
        if m is None:
            at += 1
            continue
        tag = (m["tag"] or "").lower()
        if m["comment"]:
            kind, end = "comment", source.find("-->", m.end())
            end = size if end < 0 else end + 3
        elif not tag:
            kind, end = "other", ends.plain(m.end())
        else:
            kind, end = "tag", ends.of(m.end())
        if end < 0:
            at += 1
            continue
        if tag in RAW and not m["end"]:
            close = RAW[tag].search(source, end)
            yield Markup(at, end := close.end() if close else size, "raw")
        else:
            yield Markup(at, end, kind, tag, bool(m["end"]), source[m.end() : end - 1] if tag else "")
        at = end


class Page:
    """The tokens of one page: ``kind`` is a tag feature or a box feature of words, ``text`` its words."""

    __slots__ = ("kinds", "counts", "pieces")

    def __init__(self, source: str):
        self.kinds: list[str] = []  # feature of each token
        self.counts: list[int] = []  # words of it; 0 for a tag
        self.pieces: list[tuple[str, bool]] = []  # text of it; whether a block ends before it
        stack: list[tuple[str, str]] = []  # open boxes: tag and kind
        at = 0
        for m in markup(source):
            if m.start > at:
                self.words(source[at : m.start], stack)
            at, tag = m.end, m.tag
            if not tag:
                self.kinds.append("tag:raw" if m.kind == "raw" else "tag:other")
                self.counts.append(0)
                self.pieces.append(("", m.kind != "comment"))
                continue
            self.kinds.append(f"tag:{tag if tag in BOXES or tag in ('p', 'a', 'li', 'h1', 'h2', 'div', 'br') else 'other'}")
            self.counts.append(0)
            self.pieces.append(("", tag not in INLINE))
            if m.closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID and not m.attrs.endswith("/"):
                if tag in BOXES or tag in CARRIERS:
                    stack.append((tag, box_kind(tag, m.attrs)))
        if at < len(source):
            self.words(source[at:], stack)

    def words(self, text: str, stack: list[tuple[str, str]]) -> None:
        n = len(text.split())
        self.kinds.append("in:" + next((k for _, k in reversed(stack) if k), "body"))
        self.counts.append(n)
        self.pieces.append((text, False))

    def weights(self, learned: dict[str, float]) -> list[float]:
        return [learned.get(k, -0.5) * (n or 1) if k[0] == "t" or n else 0.0 for k, n in zip(self.kinds, self.counts, strict=True)]


def box_kind(tag: str, attrs: str) -> str:
    """What box an element opens; empty if it is transparent."""
    if attrs:
        for named in NAMED.findall(attrs):
            tokens = frozenset(re.split(r"[^a-z]+", "".join(named).lower()))
            for kind, hints in HINTS:
                if tokens & hints:
                    return kind
    return tag if tag in BOXES else ""


def learn_weights(pages: tuple[str, ...] = LABELLED_PAGES) -> dict[str, float]:
    """Weights by log odds of lying in the labelled text; tags are held below zero, their mean pulled down to cost."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for source in pages:
        a, b = source.index("[["), source.index("]]")
        for part, found in ((source[:a], outside), (source[b + 2 :], outside)):
            p = Page(part)
            for k, n in zip(p.kinds, p.counts, strict=True):
                found[k] += n or k[0] == "t"
        # the labelled part keeps the boxes that stand around it
        p, q = Page(source[:b].replace("[[", "")), Page(source[:a])
        for k, n in zip(p.kinds[len(q.kinds) :], p.counts[len(q.kinds) :], strict=True):
            inside[k] += n or k[0] == "t"
    learned = {}
    for k in {*inside, *outside}:
        odds = math.log((inside[k] + 0.5) / (outside[k] + 0.5))
        learned[k] = min(-0.05, odds / 4 - 0.3) if k[0] == "t" else odds
    for kind in [h for h, _ in HINTS] + sorted(BOXES - {"article", "main", "figcaption"}):
        learned.setdefault(f"in:{kind}", -1.0)  # boxes that no labelled page shows
    learned.setdefault("in:figcaption", 0.5)
    learned["in:body"] = max(learned.get("in:body", 0.5), 0.5)
    return learned


def best_region(weights: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region of the greatest positive sum; (0, 0) if there is none."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for k, w in enumerate(weights):
        if run <= 0:
            run, start = 0.0, k
        run += w
        if run > best:
            best, at = run, (start, k + 1)
    return at


def main_text(source: str | None, learned: dict[str, float]) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    a, b = best_region(page.weights(learned))
    blocks, run = [], []
    for kind, (text, ends) in zip(page.kinds[a:b], page.pieces[a:b], strict=True):
        if ends and run:
            blocks.append("".join(run))
            run = []
        if text and learned.get(kind, -0.5) > 0:
            run.append(text)
    blocks.append("".join(run))
    tidy = (" ".join(entities.unescape(x).split()) for x in blocks)
    return " ".join(x for x in tidy if x)


def extract_main_text(pages: DataFrame, learned: dict[str, float] | None = None) -> DataFrame:
    """Per page: page_id, url, its main text and the number of code points in it."""
    learned = learned or learn_weights()

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, learned) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return map_batches(pages.select(*columns), extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
