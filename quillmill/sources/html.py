"""Pages to text: the blocks of a page, and its main content as Markdown.

A page is read once from start to end. Only block elements are kept open; what an element inherits from those around it is one
bit mask, so deep nesting costs no more than flat pages do. A construct that never ends (a tag, a comment, a script) takes the
rest of the page with it, as in browsers, and so is looked for once. Time is linear in the length of a page, whatever it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an element may be, by its tag or by words of its class, id and role.
KINDS = "article main menu header footer sidebar ad notice comments related form figure table list quote code heading hidden".split()
BIT = {kind: 1 << i for i, kind in enumerate(KINDS)}
_TAGS = {
    "article": "article", "main": "main", "nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "button": "form", "select": "form", "option": "form",
    "optgroup": "form", "label": "form", "legend": "form", "figure": "figure", "figcaption": "figure", "table": "table", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "blockquote": "quote", "pre": "code", "dialog": "notice",
    "svg": "hidden", "math": "hidden", "object": "hidden", "video": "hidden", "audio": "hidden", "canvas": "hidden", "template": "hidden", "noscript": "hidden", "datalist": "hidden", **{f"h{i}": "heading" for i in range(1, 7)},
}
_WORDS = {
    "article": "article story post entry prose",
    "main": "main content maincontent text body",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination tabs topbar toolbar skip toc",
    "header": "header masthead head",
    "footer": "footer foot contentinfo copyright legal colophon imprint",
    "sidebar": "sidebar aside side rail widget widgets complementary",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promotion promoted banner banners teaser",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay paywall disclaimer warning announcement dialog toast",
    "comments": "comment comments commentlist discussion disqus replies reply respond responses feedback",
    "related": "related recommended recommendations trending popular share sharing social tags more",
    "form": "form search login signin signup subscribe subscription newsletter register contact survey",
    "hidden": "hidden",
}
_NAMES = {word: BIT[kind] for kind, words in _WORDS.items() for word in words.split()}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul button select label svg math object video audio canvas template noscript datalist".split()
)
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: An element that ends when one of these begins directly inside it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody"}, "tbody": {"tbody", "tfoot"}, **{f"h{i}": {f"h{j}" for j in range(1, 7)} for i in range(1, 7)}}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _RAW}


@dataclass(slots=True)
class Block:
    text: str  # white space made single
    linked: int  # how many of its characters are in links
    tag: str  # the element that it is directly in
    inside: int  # kinds of all elements around it
    nearest: int  # kinds of the closest one that has any, apart from headings and lists
    row: int  # of which table row, or 0
    marked: str  # as Markdown


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _kinds(tag: str, raw: str) -> int:
    kinds = BIT.get(_TAGS.get(tag, ""), 0)
    if raw and not raw.isspace() and tag not in ("html", "body"):
        given = _attributes(raw)
        for name in ("class", "id", "role"):
            for word in _NAME_WORDS.findall(given.get(name, "")):
                kinds |= _NAMES.get(word.lower(), 0)
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", "")):
            kinds |= BIT["hidden"]
    return kinds


_LOOSE = BIT["heading"] | BIT["list"] | BIT["table"] | BIT["quote"] | BIT["code"]


def read(page: str) -> tuple[str, list[Block]]:
    """The title, or '', and the visible blocks in order."""
    title, found = "", []
    pieces: list[tuple[list[str], str | None]] = []  # text, and where it links to
    stack: list[tuple[str, int, int]] = []
    open_tags: dict[str, int] = {}
    link: str | None = None
    row = rows = linked = 0

    def flush() -> None:
        nonlocal linked
        if not pieces:
            return
        tag, inside, nearest = stack[-1] if stack else ("", 0, 0)
        text = " ".join("".join(x for part, _ in pieces for x in part).split())
        if text and not inside & BIT["hidden"]:
            marked = text
            if linked:
                parts = [("".join(part), to) for part, to in pieces]
                marked = " ".join("".join(x if to is None or x.isspace() else f"[{' '.join(x.split())}]({to})" for x, to in parts).split())
            found.append(Block(text, min(linked, len(text)), tag, inside, nearest, row if tag in ("td", "th") else 0, marked))
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = entities.unescape(text)
        if pieces and pieces[-1][1] == link:
            pieces[-1][0].append(text)
        elif text:
            pieces.append(([text], link))
        if link is not None:
            linked += len(text.strip())

    def close() -> None:
        nonlocal row
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        if tag == "tr":
            row = 0

    at = 0
    while True:
        tag_at = page.find("<", at)
        if tag_at < 0:
            add(page[at:])
            break
        if tag_at > at:
            add(page[at:tag_at])
        m = _TAG.match(page, tag_at)
        if m is None:
            ahead = page[tag_at + 1 : tag_at + 3]
            if ahead[:1].isascii() and ahead[:1].isalpha() or ahead[:1] == "/" and ahead[1:].isascii() and ahead[1:].isalpha():
                break  # a tag that never ends
            if ahead[:1] in ("!", "?", "/"):
                end = page.find("-->", tag_at + 2) + 2 if page.startswith("<!--", tag_at) else page.find(">", tag_at)
                if end < 2:
                    break
                at = end + 1
            else:
                add("<")
                at = tag_at + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if not m[1] and tag in _RAW:
            end = _CLOSING[tag].search(page, at)
            if tag == "title" and not title:
                title = " ".join(entities.unescape(page[at : end.start() if end else len(page)]).split())
            if end is None:
                break
            at = end.end()
        elif tag in BLOCKS:
            flush()
            if m[1]:
                if open_tags.get(tag):
                    while stack[-1][0] != tag:
                        close()
                    close()
                continue
            if stack and stack[-1][0] == "p":
                close()
            while stack and tag in _ENDS.get(stack[-1][0], ()):
                close()
            kinds = _kinds(tag, m[3])
            _, inside, nearest = stack[-1] if stack else ("", 0, 0)
            stack.append((tag, inside | kinds, kinds if kinds & ~_LOOSE else nearest))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag == "tr":
                rows += 1
                row = rows
        elif tag == "a":
            link = None if m[1] else _attributes(m[3]).get("href")
        elif tag in ("br", "hr"):
            add("\n")
            if tag == "hr":
                flush()
    flush()
    return title, found


_AWAY = sum(BIT[k] for k in "menu header footer sidebar ad notice comments related form".split())
_THERE = BIT["article"] | BIT["main"]


def scores(blocks: list[Block]) -> list[float]:
    """Above 0 for main content: by words, links, what is around a block, and the blocks beside it."""
    own = []
    for b in blocks:
        size = b.text.count(" ") + 1
        s = min(size / 8, 2.5) - 4 * b.linked / len(b.text) - 0.1
        s += 1.2 * bool(b.inside & _THERE) + 0.5 * (b.text[-1] in ".!?:\"'»”…。") + 0.6 * bool(b.inside & BIT["heading"])
        own_head = b.nearest & _AWAY == BIT["header"] and b.inside & _THERE and b.inside & BIT["heading"]  # an article's own
        s -= 0 if own_head else 6 if b.nearest & _AWAY else 2.5 * bool(b.inside & _AWAY)
        own.append(s)
    held = [max(-1.5, min(1.5, s)) for s in own]
    return [s + 0.3 * ((held[i - 1] if i else 0) + (held[i + 1] if i + 1 < len(held) else 0)) for i, s in enumerate(own)]


def markdown(blocks: list[Block]) -> str:
    """A line a block; the cells of a row share one."""
    lines, row = [], 0
    for b in blocks:
        if b.row and b.row == row:
            lines[-1] += " | " + b.marked
        else:
            lines.append(b.marked)
        row = b.row
    return "\n".join(lines)


def visible(page: str) -> tuple[str, str]:
    """(title or '', the main content as Markdown with links and table rows); a page of little else than links and scraps gives all that is in no menu or the like."""
    title, blocks = read(page)
    kept = [b for b, s in zip(blocks, scores(blocks), strict=True) if s > 0]
    there = [b for b in blocks if not b.inside & _AWAY]
    size = lambda some: sum(len(b.text) for b in some)
    return title, markdown(kept if 3 * size(kept) > size(there) else there)


def url_tail(url: Column) -> Column:
    """The last segment of a url, for pages without a title."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return F.element_at(F.split(bare, "/"), -1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, title and text (the main content). pages: page_id, url, html. A null page has an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [visible(p or "") for p in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "title": [t for t, _ in found], "text": [x for _, x in found]})

    out = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string")
    return out.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(url_tail(F.col("url"))))
