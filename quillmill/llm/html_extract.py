"""The main text of pages, by a linear-chain CRF over the leaf blocks of the DOM.

Every block is labelled kept or dropped. Its features are the kinds of the elements around it (menu, footer, advert, comments,
article ..., by their tags and by the words of their class, id and role), the kind of the nearest one, its own element, and what
its text is like (length, links, punctuation, digits); the chain's transitions tie it to the blocks beside it. The model is
trained on labelled pages that are made here: layouts with and without telling elements, in made-up words, so that it learns
structure and no language. Pages are decoded by Viterbi in numpy, those of a portion side by side.

All work is narrow: Arrow batches of whole pages, nothing is shuffled, and the model is some hundred numbers. Defined results: a
null page is empty and has no text; a page that shows nothing, or has nothing but menus and the like, has an empty text; broken
markup is read as browsers do, in linear time (``sources.html``); a very long page is one row of its task, whole. Repeated rows
give equal results, an empty table an empty one, and other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.sources.html import BIT, KINDS, Block, read

from .common import returning
from .line_quality import Lines, marginals

_OWN = ("p", "h1", "h2", "li", "td", "div", "quote", "code", "caption", "term", "control", "other")
_OWN_OF = {
    "p": 0, "h1": 1, **{f"h{i}": 2 for i in range(2, 7)}, "li": 3, "td": 4, "th": 4, "div": 5, "section": 5, "article": 5, "main": 5, "body": 5, "html": 5, "": 5, "blockquote": 6, "pre": 7, "figcaption": 8, "caption": 8,
    "dt": 9, "dd": 9, "button": 10, "select": 10, "option": 10, "label": 10, "legend": 10,
}
_TEXT = 10
_AWAY = sum(BIT[k] for k in "menu header footer sidebar ad notice comments related form".split())
_THERE = BIT["article"] | BIT["main"]
N_FEATURES = 2 * len(KINDS) + 3 * len(_OWN) + _TEXT + 1
_DIGITS = re.compile(r"[0-9]")


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, N_FEATURES)"""
    n = len(blocks)
    inside, nearest = (np.array([getattr(b, x) for b in blocks], np.int64)[:, None] for x in ("inside", "nearest"))
    bits = np.arange(len(KINDS))
    own = np.zeros((n, 3 * len(_OWN)))  # by where it is: in something apart, in the article, or in neither
    place = np.where(nearest & _AWAY, 0, np.where(nearest & _THERE, 1, 2))[:, 0]
    own[np.arange(n), 3 * np.array([_OWN_OF.get(b.tag, len(_OWN) - 1) for b in blocks]) + place] = 1
    text = np.zeros((n, _TEXT))
    for i, b in enumerate(blocks):
        size, last = len(b.text), b.text[-1]
        words = b.text.count(" ") + 1
        share = b.linked / size
        text[i] = (words == 1, words <= 4, words <= 12, words > 30, share > 0.25, share > 0.75, last in ".!?…。", last in ":;,", "©" in b.text or "|" in b.text, len(_DIGITS.findall(b.text, 0, 400)) * 4 > min(size, 400))
    return np.concatenate([inside >> bits & 1, nearest >> bits & 1, own, text, np.ones((n, 1))], axis=1).astype(np.float64)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray

    def kept(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The labels of the best paths; first: for each page its first block, and the end."""
        return viterbi(x @ self.weights, first, self.trans)


def viterbi(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """e: how much better "kept" scores than "dropped"; t[from, to]. Sequences go side by side, the longest first."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    first, count = first[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    live = [int(np.searchsorted(-count, -j, "left")) for j in range(longest)]  # sequences of more than j
    stay, rise = np.zeros(len(e), bool), np.zeros(len(e), bool)  # whether "kept" and "dropped" come from "kept"
    r = e[first[: live[0]]] if longest else e[:0]
    lead = np.zeros(len(first))
    for j in range(longest):
        here = first[: live[j]] + j
        if j:
            r = r[: live[j]]
            stay[here], rise[here] = t[1, 1] + r > t[0, 1], t[1, 0] + r > t[0, 0]
            r = np.maximum(t[1, 1] + r, t[0, 1]) - np.maximum(t[1, 0] + r, t[0, 0]) + e[here]
        lead[: live[j]] = r
    out = np.zeros(len(e), bool)
    now = lead > 0
    for j in range(longest - 1, -1, -1):
        here = first[: live[j]] + j
        out[here] = now[: live[j]]
        if j:
            now[: live[j]] = np.where(now[: live[j]], stay[here], rise[here])
    return out


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 2e-4) -> Model:
    """By gradient of the chains' likelihood, all at once."""
    lines = Lines(x, np.ones(len(x)), first)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    here = np.flatnonzero(inner)
    true = np.stack([(y[here - 1] == a) & (y[here] == c) for a in (0, 1) for c in (0, 1)])
    p = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    pages = len(first) - 1
    for step in range(1, steps + 1):
        t = p[N_FEATURES:].reshape(2, 2)
        e = x @ p[:N_FEATURES]
        q, f, b = marginals(e, lines, t)
        left, right = (f + e)[here - 1], (e + b)[here]
        s = np.stack([t[a, c] + a * left + c * right for a in (0, 1) for c in (0, 1)])
        s = np.exp(s - s.max(axis=0))
        g = np.concatenate([x.T @ (q - y), (s / s.sum(axis=0) - true).sum(axis=1)]) / pages + ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2))


# ---- labelled pages


class _Page:
    """A page in the making: its html, and for each of its blocks whether it is to be kept."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.html, self.labels = rng, [], []

    def words(self, least: int, most: int) -> str:
        made = ("".join(self.rng.choice("ka lo mi ren su tor va den ble sch qué ñor ul ip".split()) for _ in range(self.rng.randint(1, 3))) for _ in range(self.rng.randint(least, most)))
        return " ".join(made)

    def sentence(self, most: int = 60) -> str:
        text = self.words(1, self.rng.choice((1, 4, 12, 25, most)))
        marks = self.rng.random()
        return text.capitalize() + (self.rng.choice(".!?") if marks < 0.65 else ":" if marks < 0.7 else "")

    def block(self, tag: str, text: str, kept: bool, attributes: str = "") -> None:
        self.html.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if self.rng.random() < 0.95 or tag not in ("p", "li", "td") else ""))
        self.labels.append(kept)

    def around(self, tag: str, names: str, fill) -> None:
        """An element that names itself by its tag (no space in names means the tag alone), class, id or role."""
        chosen = self.rng.choice(names.split(",")) if names else ""
        mark = f' {self.rng.choice(("class", "class", "id"))}="{chosen}"' if chosen else ""
        self.html.append(f"<{tag}{mark}>")
        fill()
        self.html.append(f"</{tag}>")

    def links(self, kept: bool = False, most: int = 8) -> None:
        one = lambda: f'<a href="/x">{self.words(1, 4)}</a>'
        if self.rng.random() < 0.3:  # side by side, in one block
            self.block("div", " ".join(one() for _ in range(self.rng.randint(2, most))), kept)
            return
        self.html.append("<ul>")
        for _ in range(self.rng.randint(1, most)):
            self.block("li", one(), kept)
        self.html.append("</ul>")

    def bare(self, kept: bool) -> None:
        """Text directly in what is around it."""
        self.html.append(self.sentence(25))
        self.labels.append(kept)

    def some(self, tag: str, kept: bool, most: int = 3) -> None:
        for _ in range(self.rng.randint(1, most)):
            text = self.sentence(25)
            self.block(tag, f'<a href="/x">{text}</a>' if self.rng.random() < 0.3 else text, kept)


#: What stands around an article: element, names (one is taken; none for the bare element), and what it holds.
_ASIDE = (
    ("nav", "", "links"), ("div", "top,bar,row,", "links"), ("div", "nav,menu,navbar,breadcrumbs,top-menu,pagination", "links"), ("header", "", "mixed"), ("div", "header,site-header,masthead", "mixed"),
    ("footer", "", "mixed"), ("div", "footer,site-footer,legal", "mixed"), ("aside", "", "mixed"), ("div", "sidebar,widget,side-rail", "mixed"),
    ("div", "ad,ads,advert,ad-slot,sponsored,promo-box,banner", "texts"), ("div", "cookie-notice,consent,alert,notice,popup", "texts"), ("form", "", "form"), ("form", "search,newsletter,login", "form"),
    ("div", "comments,comment-list,discussion,replies", "comments"), ("section", "comments", "comments"), ("div", "related,recommended,share,social,popular", "links"),
)


def _away(page: _Page, kinds: str = "") -> None:
    """Something that is no part of the article."""
    tag, names, holds = page.rng.choice([a for a in _ASIDE if not kinds or a[2] in kinds])

    def fill() -> None:
        if holds in ("links", "mixed") and page.rng.random() < 0.8:
            page.links()
        if holds in ("mixed", "texts"):
            if page.rng.random() < 0.5:
                page.bare(False)
            else:
                page.some(page.rng.choice(("p", "div")), False, 2)
        if holds == "form":
            page.some("label", False, 2)
            page.block("button", page.words(1, 2), False)
        if holds == "comments":
            page.block(page.rng.choice(("h2", "h3")), page.words(1, 2), False)
            for _ in range(page.rng.randint(1, 5)):
                page.around(page.rng.choice(("div", "article")), page.rng.choice(("comment", "reply", "")), lambda: (page.block("p", page.sentence(), False), page.block("p", page.sentence(20), False)))

    page.around(tag, names, fill)


def _content(page: _Page) -> None:
    rng = page.rng
    if rng.random() < 0.85:
        title = lambda: page.block(rng.choice(("h1", "h1", "h2")), page.sentence(12), True)
        page.around("header", "", title) if rng.random() < 0.15 else title()
    if rng.random() < 0.12:
        page.html.append("<br>".join(page.sentence() for _ in range(rng.randint(1, 6))))
        page.labels.append(True)
        return
    for _ in range(rng.choice((1, 3, 8, 20))):
        kind = rng.random()
        if kind < 0.7:
            text = page.sentence()
            if rng.random() < 0.2:
                text = f"<b>{text}<br>"
            elif rng.random() < 0.25:
                text = f'{text} <a href="/y">{page.words(1, 3)}</a> &amp; {page.sentence(20)}'
            page.block("p", text, True)
        elif kind < 0.78:
            page.block(rng.choice(("h2", "h3")), page.words(1, 6), True)
        elif kind < 0.83:
            page.html.append("<ul>")
            for _ in range(rng.randint(1, 6)):
                page.block("li", page.sentence(20), True)
            page.html.append("</ul>")
        elif kind < 0.87:
            page.block("blockquote", page.sentence(), True)
        elif kind < 0.9:
            page.html.append("<table>")
            for _ in range(rng.randint(1, 3)):
                page.html.append("<tr>")
                page.block("td", page.words(1, 3), True)
                page.block("td", page.words(1, 3), True)
            page.html.append("</table>")
        elif kind < 0.92:
            page.block("pre", page.words(3, 20), True)
        elif kind < 0.95:
            rng.choice((lambda: page.around("div", "", lambda: page.block("p", page.sentence(), True)), lambda: page.block("div", page.sentence(), True)))()
        elif kind < 0.96:
            page.around("figure", "", lambda: page.block("figcaption", page.sentence(12), True))
        else:
            _away(page)


def labelled_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it is of the article."""
    page = _Page(rng)
    shape = rng.random()
    if rng.random() < 0.04:  # no page at all, but text
        page.bare(True)
        return page.html[0], page.labels
    whole = rng.choice(("", "", "page", "wrapper", "container"))
    page.html.append(f'<html><head><title>{page.words(2, 6)}</title></head><body><div class="{whole}">')
    for _ in range(rng.randint(0, 4)):
        _away(page)

    def article() -> None:
        _content(page)
        if rng.random() < 0.2:
            _away(page, "comments" if rng.random() < 0.5 else "")

    if shape < 0.4:
        page.around("article", rng.choice(("", "post,entry,story,article")), article)
    elif shape < 0.55:
        page.around("main", rng.choice(("", "content,main")), article)
    elif shape < 0.8:
        page.around(rng.choice(("div", "section")), "content,post-body,entry-content,article,story,main-content,text,article-body", article)
    else:
        page.around("div", rng.choice(("", "inner,col")), article)
    for _ in range(rng.randint(0, 4)):
        _away(page)
    page.html.append("</div></body></html>" if rng.random() < 0.9 else "")
    return "".join(page.html), page.labels


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 7) -> Model:
    """The model of labelled pages of this number; it does not depend on the input."""
    rng = random.Random(seed)
    made = [labelled_page(rng) for _ in range(pages)]
    blocks = [read(page)[1] for page, _ in made]
    first = np.cumsum([0, *map(len, blocks)])
    return fit(features([b for page in blocks for b in page]), first, np.array([k for _, labels in made for k in labels], np.float64))


# ---- whole tables


def main_texts(pages: list[str], model: Model) -> list[str]:
    found = [read(p)[1] for p in pages]
    first = np.cumsum([0, *map(len, found)])
    every = [b for blocks in found for b in blocks]
    if not every:
        return [""] * len(pages)
    filled = np.flatnonzero(np.diff(first))  # pages without a block have no chain
    kept = model.kept(features(every), np.append(first[filled], first[-1]))
    return ["\n".join(b.text for b, k in zip(every[i:j], kept[i:j], strict=True) if k) for i, j in zip(first[:-1], first[1:], strict=True)]


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", batch_chars: int = 2_000_000) -> DataFrame:
    """id, url, text and n_chars of each page."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            at = 0
            while at < len(htmls):
                end, size = at, 0
                while end < len(htmls) and (end == at or size + len(htmls[end]) <= batch_chars):
                    size += len(htmls[end])
                    end += 1
                texts = main_texts(htmls[at:end], model)
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])
                at = end

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(returning(run), f"`{id_col}` {kind}, url string, text string, n_chars long")
