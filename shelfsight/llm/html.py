"""Main text of web pages by two-pass block rules.

A page is cut into blocks (runs of text between block-level tags; white space
and line breaks inside a block become one space, character references are
decoded once). Scripts, styles, comments, markup and the head are left out.

Pass 1 decides a block from its surroundings and its text:
  * inside navigation, page headers, footers, sidebars, adverts, notices,
    forms or reader comments (by element, role or class/id word): bad. A form
    or class/id word may be that of a wrapper of the page ("sidebar-right"):
    on a page without an article outside of such ones, it does not count if it
    holds an article (or an element with an article's class/id word) or more
    than half of the text, unless the word names comments, adverts and the like
  * outside the article element, on a page that has one: bad
  * outside of an article, links hold more than half of its characters: bad,
    unless it reads like a sentence (stop words) or is a heading
  * long and with enough stop words for its length: good; without them, if it
    has few links and is very long, or no block of the page has them (a page in
    another language)
  * otherwise undecided (short or without stop words)
Pass 2 gives an undecided block the label of its nearest decided neighbour
among the blocks that pass 1 judged by their text, in the same article or
outside of any (a tie goes to good); without such a neighbour it is good:
nothing speaks against it.

Each page is one row and is read on its own, so nothing is shuffled.

Defined results for odd input: a NULL or empty page gives an empty text; each
row gives one row whatever its page_id; broken markup is read as far as it
goes (an unclosed tag at the end is dropped); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.quality import STOP_WORDS

LONG_CHARS = 70        # a block of this length with stop words is text
VERY_LONG_CHARS = 160  # one of this length and few links is text whatever its words
STOP_SHARE = 0.10      # of its words
FEW_LINKS = 0.25       # of its characters
LINK_SHARE = 0.5       # of its characters

# Elements by their meaning.
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title",
           "audio", "video", "map"}
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
         "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "ul", "button"} | SKIPPED
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILER_TAGS = {"nav", "aside", "footer", "button", "select", "textarea", "dialog", "menu", "fieldset"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert",
                "menu", "menubar", "toolbar", "form"}
BOILER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsbygoogle", "sponsor",
    "sponsored", "promo", "promotion", "banner", "sidebar", "sidebars", "sidenav", "nav", "navbar", "navigation",
    "menu", "menus", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "register", "related", "recommended", "recommendations", "share", "sharing", "social", "comment", "comments",
    "reply", "replies", "disqus", "respond", "footer", "masthead", "toolbar", "pager", "pagination", "widget",
    "widgets", "search", "copyright", "disclaimer"}
# Of these, the ones that name what a container holds, never a page's layout.
SIDE_WORDS = BOILER_WORDS & {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsbygoogle", "sponsor",
    "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
    "newsletter", "subscribe", "subscription", "related", "recommended", "recommendations", "share", "sharing",
    "social", "comment", "comments", "reply", "replies", "disqus", "respond", "copyright", "disclaimer"}
ARTICLE_WORDS = {"article", "post", "entry", "story"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
KEEPS = {"ul", "ol", "dl", "table", "menu", "select", "div", "section", "article", "main", "body", "tbody", "thead",
         "blockquote", "td", "th"}

_NEXT = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"(?<![^\s])hidden(?![^\s/])", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = frozenset(STOP_WORDS)


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    boiler: bool
    article: int  # number of the article it stands in, 0 for none
    wraps: tuple[int, ...] = ()  # numbers of the forms and class/id words it stands in


@dataclass
class _Open:
    tag: str
    boiler: bool
    skipped: bool
    article: int
    link: bool = False
    wraps: tuple[int, ...] = ()


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, False, 0)])
    text: list[str] = field(default_factory=list)
    links: int = 0
    heading: bool = False
    n_articles: int = 0
    layout: list[bool] = field(default_factory=list)  # of a wrapper: may be one of the page
    holds: set[int] = field(default_factory=set)      # wrappers around an article
    free: bool = False                                # an article outside of wrappers
    count: dict[str, int] = field(default_factory=dict)

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if top.skipped:
            return
        text = unescape(text)
        self.text.append(text)
        if top.link:
            self.links += len("".join(text.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, self.links, self.heading or top.tag in HEADINGS, top.boiler, top.article, top.wraps))
        self.text, self.links, self.heading = [], 0, False

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            for name in CLOSED_BY.get(tag, CLOSED_BY["p"] if self.count.get("p") else ()):
                self._close_near(name)
        if tag in VOID:
            return
        top = self.stack[-1]
        boiler, article, wraps = self._meaning(tag, attrs, top)
        self.stack.append(_Open(tag, boiler, top.skipped or tag in SKIPPED, article, top.link or tag == "a", wraps))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _meaning(self, tag: str, attrs: str, top: _Open) -> tuple[bool, int, tuple[int, ...]]:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
        words = [w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")]
        role = found.get("role", "").lower()
        boiler = top.boiler or tag in BOILER_TAGS or role in BOILER_ROLES or tag == "header" and not top.article
        if "hidden" in attrs.lower() and ("hidden" in found or _HIDDEN.search(_QUOTED.sub("", attrs))):
            boiler = True
        if found:
            boiler = boiler or found.get("aria-hidden", "").lower() == "true" or bool(
                re.search(r"display\s*:\s*none", found.get("style", "").lower()))
        named = set()
        if words and tag not in ("html", "body", "main") and not {"has", "with", "no", "without"} & set(words):
            named = BOILER_WORDS & set(words) | ({"header"} & set(words) if not top.article else set())
        article, wraps = top.article, top.wraps
        if named or tag == "form":
            wraps = (*wraps, len(self.layout))
            # what stands inside an article is never a wrapper of the page
            self.layout.append(not top.article and not SIDE_WORDS & named)
        is_article = (tag in ("article", "main") or role in ("main", "article")
                      or found.get("itemprop") == "articleBody")
        if not boiler and not article and (is_article or not named and ARTICLE_WORDS & set(words)):
            if wraps:
                self.holds.update(wraps)
            else:
                self.free = True
        if not boiler and not article and is_article:
            self.n_articles += 1
            article = self.n_articles
        return boiler, article, wraps

    def finish(self) -> list[Block]:
        """The blocks; those in a wrapper that is not the page's are boiler."""
        self.flush()
        rest = [b for b in self.blocks if not b.boiler]
        size = [0] * len(self.layout)
        for b in rest:
            for w in b.wraps:
                size[w] += len(b.text)
        half = sum(len(b.text) for b in rest) / 2
        wide = {w for w, ok in enumerate(self.layout) if ok and not self.free and (w in self.holds or size[w] > half)}
        for b in rest:
            b.boiler = not wide.issuperset(b.wraps)
        return self.blocks

    def _close_near(self, tag: str) -> None:
        """Close an open ``tag`` unless a container stands in between."""
        if not self.count.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if self.stack[i].tag in KEEPS:
                return

    def _pop_to(self, i: int) -> None:
        for o in self.stack[i:]:
            self.count[o.tag] -= 1
        del self.stack[i:]

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.count.get(tag):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    self._pop_to(i)
                    return


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in page order."""
    page, at, n = _Page(), 0, len(html)
    while at < n:
        m = _NEXT.search(html, at)
        if not m:
            page.add(html[at:])
            break
        if m.start() > at:
            page.add(html[at:m.start()])
        start = m.start()
        if m[0] == "<!--":
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
        elif m[0] in ("<!", "<?"):
            end = html.find("]]>" if html.startswith("<![CDATA[", start) else ">", start)
            at = n if end < 0 else end + (3 if html.startswith("<![CDATA[", start) else 1)
        else:
            t = _TAG.match(html, start)
            if not t:  # quotes that never close: take the tag up to the next >
                end = html.find(">", start)
                if end < 0:
                    break
                t = re.match(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", html[start:end + 1])
                at = end + 1
            else:
                at = t.end()
            tag = t[2].lower()
            if t[1]:
                page.close(tag)
                continue
            page.open(tag, t[3])
            if tag in RAW and not t[3].endswith("/"):
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = n if not end else end.start()
    return page.finish()


def _stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in _STOPS for w in words) / max(1, len(words))


def _first_pass(b: Block, has_article: bool, reads: bool, known: bool) -> bool | None:
    """``reads``: the block has stop words; ``known``: some long block of the
    page does, so that lacking them says something."""
    if b.boiler or has_article and not b.article:
        return False
    size = len(b.text.replace(" ", ""))
    if not b.article and b.link_chars > LINK_SHARE * size:
        return None if b.heading or reads and len(b.text) >= LONG_CHARS else False
    if len(b.text) >= LONG_CHARS and reads:
        return True
    if len(b.text) >= (VERY_LONG_CHARS if known else LONG_CHARS) and b.link_chars <= FEW_LINKS * size:
        return True
    return None


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the main text, in page order."""
    has_article = any(b.article and not b.boiler for b in blocks)
    reads = [not b.boiler and _stop_share(b.text) >= STOP_SHARE for b in blocks]
    known = any(r and len(b.text) >= LONG_CHARS for r, b in zip(reads, blocks, strict=True))
    label = [_first_pass(b, has_article, r, known) for r, b in zip(reads, blocks, strict=True)]
    # surroundings decide a block but say nothing about its neighbours
    votes = [x is not None and not b.boiler and bool(b.article) == has_article for x, b in zip(label, blocks, strict=True)]
    n = len(blocks)
    before, after, seen = [None] * n, [None] * n, {}
    for i in range(n):
        before[i] = seen.get(blocks[i].article)
        if votes[i]:
            seen[blocks[i].article] = i
    seen = {}
    for i in reversed(range(n)):
        after[i] = seen.get(blocks[i].article)
        if votes[i]:
            seen[blocks[i].article] = i
    out = []
    for i, b in enumerate(blocks):
        keep = label[i]
        if keep is None:
            near = [(abs(j - i), not label[j]) for j in (before[i], after[i]) if j is not None]
            keep = not min(near)[1] if near else True
        if keep:
            out.append(b)
    return out


def extract(html: str) -> str:
    return "\n".join(b.text for b in main_blocks(blocks_of(html)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) per row of ``pages``."""
    rows = pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                text = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                     pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
