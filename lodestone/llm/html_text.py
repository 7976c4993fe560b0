"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; words under elements that
labelled pages show to be furniture score negative as well. A linear scan finds the contiguous region with
the greatest sum, and the words of that region that do not stand under furniture are the text.

All weights come from ``labelled_pages``: small pages whose main text is marked by ``data-main``. A tag's
weight grows with the share of its occurrences that begin or end the main text; a word's weight is the least log-odds
of the elements around it, told apart by tag, and by the words in class, id and role. A name of several words of which
one is unknown ("share-price") tells little: it only lowers the score (DOUBT), and the region decides.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_TAG = re.compile(r"""</?[A-Za-z][^\s/>]*(?:[^>"']|"[^"]*"|'[^']*')*>""")
_MARK = re.compile(r"<(?:[A-Za-z/!?])")
_ATTR = re.compile(r"""\s(class|id|role|data-main|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is no text of the page.
_RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "select", "object", "canvas", "math", "audio", "video", "button")
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}
#: Raw elements that go on to the end of the page where they are not closed.
_REST = {"script", "style", "textarea", "title", "iframe"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that run on within a line; every other tag ends a block.
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", *_RAW}
#: Blocks that an unclosed inline element can't leave.
_PARAGRAPH = {"p", "br", "b", "i", "em", "strong", "span", "font", "u", "small"}

#: Blocks that end an open paragraph.
_ENDS_P = {"p", "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "dd", "dt", "main", "menu", "nav", "ol", "pre", "search", "section", "summary", "table", "ul"}

#: Score of a tag that always begins or ends the main text; of a furniture word, per unit of its log-odds. The latter is
#: small, as such words are dropped wherever they stand, and a notice must not part a short end from its article.
EDGE, FURNITURE = 40.0, 0.03
#: Score of a word under a name that holds a furniture word and one that neither the labels nor LAYOUT know.
DOUBT = 0.25
#: Words that tell in names where or how a thing is laid out, not what it is.
LAYOUT = set("area article articles bar block bottom box button buttons col column container content desktop entry global group holder icon icons inner item items js left link links list main mobile module outer page panel post posts primary region right row section secondary site slot title top unit user users wrap wrapper zone".split())


@lru_cache(1)
def labelled_words() -> frozenset[str]:
    """The words in class, id and role of the labelled pages."""
    named = re.compile(r"(?:class|id|role)=('[^']*'|[^\s>']+)")
    return frozenset(x.lower() for page in labelled_pages() for v in named.findall(page) for x in _PIECE.findall(v))


def tokens(page: str) -> Iterator[tuple[str, str, list[str]]]:
    """("text", s, []), ("open" | "close" | "void", tag, words of its attributes). Comments, declarations and raw
    elements are passed over; an unclosed comment, script or the like (_REST) ends the page."""
    at, n, known = 0, len(page), labelled_words()
    unclosed: set[str] = set()
    while at < n:
        m = _MARK.search(page, at)
        if not m:
            yield "text", page[at:], []
            return
        if m.start() > at:
            yield "text", page[at : m.start()], []
        at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, at)
        if not name:  # "</" before no name
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        tag, close = name[1].lower(), page[at + 1] == "/"
        whole = _TAG.match(page, at)
        if whole:
            at, shown = whole.end(), whole[0]
        else:  # no end, or an odd quote
            end = page.find(">", at)
            at, shown = (n, page[at:]) if end < 0 else (end + 1, page[at : end + 1])
        if close:
            yield "close", tag, []
            continue
        if tag in _END and not shown.endswith("/>"):
            end = None if tag in unclosed else _END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in _REST:
                at = n
            else:
                unclosed.add(tag)
            yield "void", tag, []
            continue
        marks = []
        if len(shown) > len(tag) + 2:
            for k, v in _ATTR.findall(shown):
                k, v = k.lower(), v.strip("\"'")
                if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.I):
                    marks.append("#hidden")
                elif k == "data-main":
                    marks.append("#main" if v == "1" else "#other")
                elif k != "style":
                    for name in v.split():
                        pieces = [x.lower() for x in _PIECE.findall(name)]
                        sure = len(pieces) < 2 or all(x in LAYOUT or x in known for x in pieces)
                        marks += [f"{'.' if sure else '?'}{x}" for x in pieces]
        yield ("void" if tag in _VOID or shown.endswith("/>") else "open"), tag, marks


def walk(page: str) -> Iterator[tuple[str, str, tuple[tuple[str, ...], ...]]]:
    """Tokens with the features of the open elements around them; elements that seldom close open none."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    frozen: tuple[tuple[str, ...], ...] = ()
    standing: Counter[str] = Counter()  # open elements by tag

    def end(i: int, j: int | None = None) -> None:
        nonlocal frozen
        standing.subtract(t for t, _ in stack[i:j])
        del stack[i:j]
        frozen = tuple(f for _, f in stack)

    for kind, what, marks in tokens(page):
        if kind != "close" and what in _ENDS_P and standing["p"]:
            i = len(stack) - 1
            while i >= 0 and stack[i][0] in _INLINE:
                i -= 1
            if i >= 0 and stack[i][0] == "p":
                end(i)
        if kind == "open" and (what not in _PARAGRAPH or marks):
            if what in ("li", "a", "dd", "dt", "td", "th", "tr", "option") and stack and stack[-1][0] == what:
                end(len(stack) - 1)
            if what in ("html", "body"):  # their classes tell of the page, not of its words
                marks = [x for x in marks if x[0] == "#"]
            stack.append((what, (what, *marks)))
            standing[what] += 1
            frozen = tuple(f for _, f in stack)
        elif kind == "close" and standing[what]:
            i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == what)
            # a close tag ends what stands open inside its element, but an inline one doesn't leave a block
            if what == "a" and any(t not in _INLINE for t, _ in stack[i + 1 :]):
                end(i, i + 1)
            else:
                end(i)
        yield kind, what, frozen


def labelled_pages() -> list[str]:
    """Pages with their main text marked, in the common layouts of articles, posts and plain pages."""
    body = "".join(f"<p>The {a} of the {b} was <a href='/x'>{c}</a> and <em>held</em> for long.</p>" for a, b, c in (("first", "river", "wide"), ("name", "town", "old"), ("work", "day", "long")))
    rest = "<h2>More words</h2><ul><li>one thing said here in full</li><li>another thing said here</li></ul><ol><li>first of <a href='/y'>these</a> things</li></ol><blockquote>It was said so.</blockquote><table><tr><td>one cell</td><td>two</td></tr></table><figure><figcaption>A view of it</figcaption></figure><pre>kept as is</pre><section><h2>A part</h2><p>Words of this part.</p></section><section><div><p>Words of that part.</p></div></section><div><div>More</div><div>of</div><div>them</div></div>"
    head = "<h1>What is <b>told</b> here</h1>"
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("home", "news", "sport"))
    kinds = [
        "nav", "header", "footer", "aside", "form", "dialog", "menu", "address", "fieldset",
        "div class=nav", "div class=navbar", "div id=navigation", "div class='main-menu'", "ul class=menu", "div class=breadcrumb", "div class=breadcrumbs", "div role=navigation", "div class=topbar", "div class=toolbar", "div class=pagination", "div class=pager", "div class=toc",
        "div class=header", "div id=masthead", "div role=banner", "div class=footer", "div id=foot", "div role=contentinfo", "div class=copyright", "div class=legal", "div class=colophon",
        "div class=sidebar", "div id=side", "div role=complementary", "div class=widget", "div class=rail", "div class=related", "div class=recommended", "div class=trending", "div class=popular", "div class=teaser", "div class='more-links'",
        "div class=ad", "div class=ads", "div id=advert", "div class=advertisement", "div class=advertising", "div class=sponsored", "div class=sponsor", "div class=promo", "div class=promotion", "div class=banner", "div class=adsbygoogle",
        "div class=notice", "div class=notification", "div class='cookie-consent'", "div id=cookies", "div class=gdpr", "div class=alert", "div class=disclaimer", "div class=popup", "div class=modal", "div class=overlay", "div class=paywall", "div class=privacy", "div role=alert",
        "div class=newsletter", "div class=subscribe", "div class=subscription", "div class=signup", "div class=login", "div class=search", "div role=search", "div class=share", "div class=sharing", "div class=social", "div class=follow",
        "div class=comments", "div class=comment", "section id=comments", "div id=disqus", "ol class='comment-list'", "div class=reply", "div class=respond", "div class=discussion", "div class=feedback", "div class=reader", "div hidden", "div style='display:none'", "div aria-hidden=true",
    ]
    mains = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry", "div class='article-body'", "section class=story", "div class=text", "div", "article class=post", "section", "div class='main-content'", "div id=main", "div class='list more links'"]
    pages = []
    for i, kind in enumerate(kinds):
        name = kind.split()[0]
        extra = f"<{kind}><p>Some other words that stand beside it.</p></{name}>"
        list_ = f"<{kind}><ul>{links}</ul></{name}>"
        main = mains[i % len(mains)]
        inner = head + body + (extra if i % 3 == 0 else "") + (rest if i % 2 else "") + body
        marked = f"<{main} data-main=1>{inner.replace(f'<{kind}>', f'<{kind} data-main=0>')}</{main.split()[0]}>"
        before = f"<nav><ul>{links}</ul></nav>" if i % 2 else f"<header><a href=/>Site</a><ul>{links}</ul></header>"
        pages.append(f"<html><head><title>t</title></head><body>{before}{list_ if i % 2 else extra}{marked}{extra if i % 2 else list_}<footer><p>Words at the end.</p></footer></body></html>")
    return pages


@lru_cache(1)
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """(score of each element feature for words, score of each tag), fitted to labelled_pages."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    tags: Counter[str] = Counter()
    edge: Counter[str] = Counter()
    for page in labelled_pages():
        before = False
        for kind, what, stack in walk(page):
            flat = {f for fs in stack for f in fs}
            last = next((f for fs in reversed(stack) for f in fs if f in ("#main", "#other")), "#other")
            main = last == "#main"
            if kind == "text":
                (inside if main else outside).update({f: len(what.split()) for f in flat})
            else:
                within = "#main" in flat
                key = what if kind != "close" else f"/{what}"
                tags[key] += 1
                edge[key] += within != before
                before = within
    words = {f: log((inside[f] + 0.5) / (outside[f] + 0.5)) for f in inside.keys() | outside.keys() if f not in ("#main", "#other")}
    # a feature that the labels show outside only, or nearly so, makes furniture of what it holds
    words = {f: FURNITURE * v for f, v in words.items() if v < -3.0}
    return words, {t: -max(0.05, EDGE * (edge[t] / n) ** 2) for t, n in tags.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous [start, end) of greatest sum, the first of equals; empty where none is above 0."""
    best = total = 0.0
    start, found = 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def wrappers(items: list[tuple[str, str, tuple]], by_word: dict[str, float]) -> set[int]:
    """Ids of the elements that furniture words in class, id or role name, but that wrap the page: most of its words
    stand in them, and outside of them and of other furniture stand few, and no h1, main or article."""
    total, held = 0, Counter()
    for kind, what, stack in items:
        if kind == "text" and (n := len(what.split())):
            total += n
            held.update(dict.fromkeys(map(id, stack), n))
    named = {i for i, n in held.items() if 2 * n > total}
    chain: dict[int, int] = {}  # each stands in the one before it
    for _, _, stack in items:
        for f in stack:
            if id(f) in named and id(f) not in chain and any(x[0] == "." and x in by_word for x in f):
                chain[id(f)] = len(chain)
    if not chain:
        return set()
    clean, landmark = Counter(), Counter()  # by how many of the chain stand around
    for kind, what, stack in items:
        if kind in ("text", "open"):
            inside = [id(f) in chain for f in stack]
            if not any(x in by_word for f, c in zip(stack, inside, strict=True) for x in f if not c or x[0] != "."):
                if kind == "text":
                    clean[sum(inside)] += len(what.split())
                elif what in ("h1", "main", "article"):
                    landmark[sum(inside)] += 1  # with the element itself, where it is of the chain
    out: set[int] = set()
    few = marked = 0
    for i, k in chain.items():
        few += clean[k]
        marked += landmark[k]
        if 10 * few >= held[i] or marked:
            break
        out.add(i)
    return out


def extract(page: str | None) -> str:
    """Main text of a page; blocks joined by one space, white space runs within them one space."""
    if not page:
        return ""
    by_word, by_tag = weights()
    scores: list[float] = []
    shown: list[str] = []
    known: dict[int, float] = {}
    items = list(walk(page))
    wrap = wrappers(items, by_word)
    for kind, what, stack in items:
        if kind == "text":
            at = id(stack)
            if at not in known:
                known[at] = min((DOUBT if f[0] == "?" and f".{f[1:]}" in by_word else by_word.get(f, 1.0) for fs in stack for f in fs if f[0] not in ".?" or id(fs) not in wrap), default=1.0)
            text = entities.unescape(what) if "&" in what else what
            n = len(text.split())
            scores.append(known[at] * n)
            shown.append(text if known[at] > 0 else " ")
        else:
            scores.append(by_tag.get(what if kind != "close" else f"/{what}", -0.05 if what in _INLINE else -0.2))
            shown.append("" if what in _INLINE else " ")
    a, b = best_region(scores)
    return " ".join("".join(shown[a:b]).split())


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points). A null html gives the empty text, as does a page without
    main words; every row stays, repeated ones too; columns named text or n_chars give way."""
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "html")]
    used = pages.select(*(f"`{c}`" for c in kept), "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema if f.name in kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return used.mapInArrow(run, (schema + ", " if schema else "") + "text string, n_chars bigint")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("text"), "n_chars")
