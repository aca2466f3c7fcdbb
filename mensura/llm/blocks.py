"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block elements. The first pass decides
blocks by where they stand (menus, forms, notices, comments and the like), by
link density, by length and by the density of stop words. What it cannot
decide, mostly short blocks, then takes the label of the nearest decided
neighbours within the same region of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux avec ce dans de du elle en est et il la le les ne par pas pour qui que sur un une "
    "al como con del el es esta las lo los no para por se su una y".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var br wbr img".split())
PARAGRAPHS = frozenset("p pre blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
ASIDE = frozenset(
    "head nav footer aside form button select option dialog menu noscript template svg math iframe object canvas "
    "audio video".split())
#: Words in class, id and role that mark what is not main text.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget "
    "menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager footer masthead comment comments "
    "commentlist reply replies respond disqus discussion share sharing social related recommended recommendations "
    "teaser teasers tags skip copyright complementary contentinfo search form".split())
#: Marked words of what may hold articles of its own.
OWN_ARTICLES = frozenset(
    "comment comments commentlist reply replies respond disqus discussion related recommended recommendations "
    "teaser teasers ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Marked words that wrappers of running text have as well: a paragraph of text stays.
WEAK = frozenset(
    "search form tags share sharing social skip copyright widget toolbar banner menu nav navbar navigation alert "
    "modal overlay popup".split())
#: Names that begin so say something about an element and not what it is.
QUALIFIERS = frozenset("has with no without not hide show".split())
#: Opening one of these closes an open one of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("ul ol dl table body article main section div".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W\d_]+")

LONG, SHORT = 15, 10         # words
STOPS_HIGH, STOPS_LOW = 0.2, 0.08
LINKS_HIGH = 0.5
#: In a region, stop words so many standard deviations fewer than those of text tell a block that is none.
DEVIATIONS = 4.0


@dataclass(slots=True)
class Block:
    text: str
    links: float      # share of its characters inside links
    aside: bool       # stands in a menu, form, notice, ...
    region: int       # number of the article or main element around it, 0 for none
    heading: bool
    paragraph: bool   # marked up as running or preformatted text
    weak: bool        # aside only by names that are ``WEAK``


def _marked(attributes: str, names: bool) -> int:
    """3: never main text; 2: not main text but for an article or main inside; 1: the same, by a weak name; 0: not marked."""
    if not attributes or attributes.isspace():
        return 0
    if _HIDDEN.search(attributes):
        return 3
    out = 0
    for m in _NAMES.finditer(attributes) if names else ():
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = re.findall(r"[a-z]+", name)
            if words and words[0] not in QUALIFIERS and not MARKED.isdisjoint(words):
                out = max(out, 3 if not OWN_ARTICLES.isdisjoint(words) else 2 if MARKED & set(words) - WEAK else 1)
    return out


def blocks(page: str, names: bool = True) -> list[Block]:
    """The blocks of a page in order, without empty ones. Without ``names``,
    class, id and role mark nothing."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, aside (as _marked), region, link, heading
    state = ("", 0, 0, False, False)
    parts: list[str] = []
    linked, regions, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(1.0, linked / len(text)), state[1] > 0, state[2], state[4],
                             next((s[0] for s in reversed(stack) if s[0] not in INLINE), "") in PARAGRAPHS, state[1] == 1))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state[3]:
                linked += len(text.strip())

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        add(page[pos:m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if closing:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != tag:
                depth -= 1
            if tag not in INLINE:
                close()
            if depth >= 0:
                if any(s[1] != (stack[depth - 1][1] if depth else 0) for s in stack[depth:]):
                    close()
                del stack[depth:]
            state = stack[-1] if stack else ("", 0, 0, False, False)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        block = tag not in INLINE
        marked = 3 if tag in ASIDE or (tag == "header" and not state[2]) else _marked(attributes, names)
        if block or marked:
            close()
        if block and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in SIBLINGS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in SIBLINGS[tag]:
                    del stack[depth:]
                    break
                if stack[depth][0] in _HOLDERS:
                    break
        state = stack[-1] if stack else ("", 0, 0, False, False)
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div"):
            continue
        region = state[2]
        aside = max(state[1], 0 if tag in ("html", "body", "main") else marked)
        if tag in ("article", "main") and aside < 3 and not region:
            # names around it, or its own, do not take a page's article away
            aside = 0
            regions += 1
            region = regions
        state = (tag, aside, region, state[3] or tag == "a", tag in HEADINGS or (state[4] and not block))
        stack.append(state)
        at += 1
    close()
    return out


def labels(found: list[Block]) -> list[bool]:
    """True for blocks of main text."""
    counted = []
    for b in found:
        words = [w.lower() for w in _WORD.findall(b.text)]
        counted.append((len(words), sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0))
    full = [b.links <= LINKS_HIGH and n >= LONG and stops >= STOPS_HIGH for b, (n, stops) in zip(found, counted)]
    # a weak name does not take away what has a paragraph with the stop words of text in it
    aside = [b.aside for b in found]
    at = 0
    while at < len(found):
        end = at + 1
        if found[at].weak:
            while end < len(found) and found[end].weak:
                end += 1
            if any(full[k] and found[k].paragraph for k in range(at, end)):
                aside[at:end] = [False] * (end - at)
        at = end
    good = [ok and not off for ok, off in zip(full, aside)]
    # articles without any text may be teasers of a page whose text stands elsewhere
    textual = {b.region for b, yes in zip(found, good) if yes}
    # few stop words say something only where the page is in a language that has them here
    known_language = bool(textual)

    def first(i: int) -> bool | None:
        b, (n, stops) = found[i], counted[i]
        if aside[i]:
            return False
        if b.links > LINKS_HIGH:
            # one linked heading or paragraph goes with its neighbours, a run of links does not
            alone = b.paragraph and not any(found[k].links > LINKS_HIGH for k in (i - 1, i + 1) if 0 <= k < len(found))
            return None if b.region and (b.heading or alone) else False
        if good[i]:
            return b.region > 0 or "©" not in b.text
        if b.region and (b.region in textual or 0 not in textual):
            room = DEVIATIONS * (n * STOPS_HIGH * (1 - STOPS_HIGH)) ** 0.5
            if known_language and not b.paragraph and stops < STOPS_LOW and stops * n + room < STOPS_HIGH * n:
                return False
            return True if n >= SHORT or stops >= STOPS_HIGH else None
        if b.region or "©" in b.text:
            return False
        if told:
            return False
        if n >= LONG and stops < STOPS_LOW:  # keywords, or a language that has no stop words here
            return not textual
        return None

    told = any(b.region and not off and (b.region in textual or 0 not in textual) for b, off in zip(found, aside))
    known = [first(i) for i in range(len(found))]
    if not any(known):  # no block is decided to be main text: what is undecided is all there is
        return [k is None for k in known]
    n = len(found)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    seen: dict[int, int] = {}
    for i in range(n):
        before[i] = seen.get(found[i].region)
        if known[i] is not None and not aside[i]:
            seen[found[i].region] = i
    seen = {}
    for i in range(n - 1, -1, -1):
        after[i] = seen.get(found[i].region)
        if known[i] is not None and not aside[i]:
            seen[found[i].region] = i
    out = []
    for i, b in enumerate(found):
        if known[i] is not None:
            out.append(known[i])
            continue
        x, y = before[i], after[i]
        if b.heading and y is not None:
            x = None  # a heading goes with what follows
        if x is None and y is None:
            out.append(b.region > 0)
        elif x is None or y is None:
            out.append(bool(known[y if x is None else x]))
        elif known[x] == known[y]:
            out.append(bool(known[x]))
        else:
            out.append(bool(known[x if i - x < y - i else y]) if i - x != y - i else b.region > 0)
    return out


def main_text(page: str | None) -> str:
    """Main text of a whole page: character references decoded, white space
    inside a block turned into one space, blocks joined by one space."""
    for names in (True, False):  # names that would leave nothing of a page are no marks
        found = blocks(page or "", names)
        text = " ".join(b.text for b, good in zip(found, labels(found)) if good)
        if text or not any(b.aside for b in found):
            break
    return text


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of
    ``pages`` (null html: empty; long pages are read whole). Rows are
    independent: repeated ones come back repeated, an empty table gives an empty result, and other columns
    are ignored."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                text = [main_text(p) for p in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page_id": some.column("page_id"), "url": some.column("url"),
                    "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html")).mapInArrow(
        texts, "page_id bigint, url string, text string, n_chars bigint")
