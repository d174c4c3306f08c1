"""Main text of web pages from flat text blocks.

A page becomes a list of text blocks: the text between block-level tags, with
scripts, styles, comments and the head left out. A block has its word count and
link density, those of the blocks before and after it, whether it is a
paragraph (or list item, cell, quotation) or a heading, and whether it stands in
an article or main element, if the page has one. A decision tree, trained here
on a small labelled table of pages, decides from these which blocks are main
text.

What a page marks as something else is no candidate, wherever it stands: text in
menus, page headers, footers, sidebars, forms, buttons and dialogs, in hidden
elements, and in elements whose class, id or role names an advert, a notice, a
comment section and the like. To its neighbours it counts as a block of links.

Null and empty pages give an empty text. Unclosed, stray and cut-off tags are
tolerated; time is linear in the page's length, whatever the length of a block.
Repeated rows get equal results. Other columns stay, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, fresh

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|template|svg|math|iframe|noscript|textarea|title)\b(?:.*?</\1\s*(?:>|\Z)|.*\Z)"
    r"|</?([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|[^<]++|<", re.DOTALL | re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split())
_BOILER = frozenset("nav header footer aside form menu button select option dialog fieldset label input".split())
_MAIN = frozenset(("article", "main"))
_PROSE = frozenset("p li dd dt td th blockquote pre figcaption caption summary q".split())
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\shidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_HAS = re.compile(r"(?:^|(?<=\s))(?:with|has|no|without)-\S+", re.IGNORECASE)
#: Words of class, id and role values that name something beside the main text.
_HINT = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer\w*|masthead|header|toolbar|pagination|pager|share\w*|sharing|"
    r"social\w*|comments?\w*|disqus|reply|replies|respond|related\w*|recommend\w*|newsletter|subscri\w*|signup|login|search|"
    r"widget\w*|legal|copyright|disclaimer)(?:[^a-z]|$)", re.IGNORECASE)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool  # marked as something beside the main text
    main: bool
    prose: bool
    heading: bool

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def blocks_of(page: str | None) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    heading = False
    # Open elements: name, then flags of everything around (boiler, hint, main).
    stack: list[tuple[str, bool, bool, bool]] = []
    count: dict[str, int] = {}
    in_link = False

    def flush() -> None:
        nonlocal parts, linked, heading
        words = entities.unescape("".join(parts)).split()
        if words:
            tag, boiler, hint, main = stack[-1] if stack else ("", False, False, False)
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), boiler or hint, main, tag in _PROSE, heading))
        parts, linked, heading = [], 0, False

    for m in _PIECE.finditer(page or ""):
        piece, name = m.group(), m.group(2)
        if m.group(1) or piece.startswith(("<!", "<?")):
            continue
        if name is None:
            parts.append(piece)
            if in_link:
                linked += len(piece.split())
            continue
        name = name.lower()
        closing = piece.startswith("</")
        if name == "a":
            in_link = not closing
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        heading = not closing and re.fullmatch("h[1-6]", name) is not None
        if closing:
            if count.get(name):
                in_link = False
                while stack:
                    top = stack.pop()[0]
                    count[top] -= 1
                    if top == name:
                        break
            continue
        if name in _VOID or piece.endswith("/>"):
            continue
        # A new paragraph or list item ends one that was left open beside it.
        if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and stack and stack[-1][0] == name:
            count[stack.pop()[0]] -= 1
        _, boiler, hint, main = stack[-1] if stack else ("", False, False, False)
        attrs = m.group(3) or ""
        named = " ".join(a or b or c for a, b, c in _NAME.findall(attrs)) if attrs else ""
        boiler = boiler or (name in _BOILER and not (name == "header" and main))
        if name == "main":
            hint = False  # "<div class=with-sidebar><main>": the container is no sidebar
        hint = hint or bool(named and name not in ("body", "html") and _HINT.search(_HAS.sub("", named))) or bool(
            attrs and _HIDDEN.search(attrs))
        if name != "html":
            stack.append((name, boiler, hint, main or name in _MAIN))
            count[name] = count.get(name, 0) + 1
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "prose", "heading",
            "main", "page_has_main")


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES a block. A neighbour that is marked as something
    else counts as no words, all linked; the page's ends as no words."""
    around = [(0, 0.0), *((0, 1.0) if b.aside else (b.words, b.link_density) for b in blocks), (0, 0.0)]
    has_main = any(b.main and not b.aside for b in blocks)
    return np.array([[b.words, b.link_density, *before, *after, b.prose, b.heading, b.main, has_main]
                     for b, before, after in zip(blocks, around, around[2:], strict=False)],
                    dtype=np.float64).reshape(len(blocks), len(FEATURES))


# ---------------------------------------------------------- labelled pages


PAGES = 600


def labelled_pages() -> list[tuple[str, set[str]]]:
    """The small labelled table: pages made from layouts by a fixed rule, with
    the blocks that are main text. Articles stand in an article element, in
    main, in plain divisions or bare in the body; their paragraphs may be long
    or short; links stand inside them, and lists of links beside and among them."""
    rng = np.random.default_rng(31)
    vocabulary = ("river stone market window letter garden winter common measure quiet north paper engine harbour simple "
                  "village record number weather story").split()

    def say(low: int, high: int) -> str:
        return " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(low, high)))) + f"{rng.integers(1 << 30)}."

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{say(1, 5)}</a></{tag}>' for _ in range(n))

    pages = []
    for k in range(PAGES):
        good: set[str] = set()

        def main_text(low: int, high: int) -> str:
            text = say(low, high)
            good.add(text)
            return text

        longest, shortest = int(rng.choice([4, 12, 25, 45, 80])), 1
        tag = "p" if rng.random() < 0.7 else "div"
        if tag == "div" and k % 4 > 1:  # only its length sets it apart
            longest, shortest = max(longest, 25), 9

        def paragraph() -> str:
            kind = rng.random()
            if kind < 0.6:
                return f"<{tag}>{main_text(shortest, longest)}</{tag}>"
            if kind < 0.7:  # with a link inside
                start, linked, end = say(6, 30), say(1, 3), say(6, 30)
                good.add(f"{start} {linked} {end}")
                return f'<{tag}>{start} <a href="/y">{linked}</a> {end}</{tag}>'
            if kind < 0.78:
                return "<ul>" + "".join(f"<li>{main_text(2, longest + 2)}</li>" for _ in range(3)) + "</ul>"
            if kind < 0.84:
                return f"<blockquote>{main_text(3, longest + 3)}</blockquote>"
            if kind < 0.9:
                return f"<h2>{main_text(1, 6)}</h2><p>{main_text(4, longest + 4)}</p>"
            return f"<table><tr><td>{main_text(1, 8)}</td><td>{main_text(1, 8)}</td></tr></table>"

        body = [paragraph() for _ in range(int(rng.integers(2, 9)))]
        inner = [f"<aside>{say(3, 60)}</aside>", f"<form><label>{say(1, 9)}</label><button>{say(1, 3)}</button></form>",
                 f"<nav>{links(2, 'span')}</nav>", f"<ul>{links(4)}</ul>", f'<p><a href="/z">{say(2, 12)}</a></p>',
                 f'<section class="comments"><h3>{say(1, 3)}</h3><p>{say(3, 60)}</p></section>']
        for x in inner:
            if rng.random() < 0.2:
                body.insert(int(rng.integers(1, len(body) + 1)), x)
        title = f"<h1>{main_text(1, 9)}</h1>" if rng.random() < 0.7 else ""
        before = [f"<nav><ul>{links(6)}</ul></nav>", f'<div class="ad">{say(3, 60)}</div>',
                  f"<header><h2>{say(2, 5)}</h2><p>{say(3, 60)}</p></header>", f'<div id="cookie-notice"><p>{say(3, 80)}</p></div>',
                  f"<div>{links(3, 'span')}</div>", f"<ul>{links(5)}</ul>", f"<div>{say(1, 5)}</div>"]
        after = [f"<footer>{say(3, 90)}</footer>", f"<aside><h3>{say(2, 4)}</h3><p>{say(3, 60)}</p></aside>",
                 f"<form><label>{say(1, 30)}</label><button>Send</button></form>", f"<ul>{links(9)}</ul>",
                 f'<section class="comments"><h3>{say(1, 3)}</h3><p>{say(3, 60)}</p><p>{say(1, 9)}</p></section>',
                 f'<div class="related"><a href="/x">{say(3, 12)}</a></div>', f"<h3>{say(1, 3)}</h3><ul>{links(4)}</ul>",
                 f"<div>{say(1, 8)}</div>"]
        text = "".join(body)
        main = (f"<article>{title}{text}</article>", f"<main>{title}{text}</main>", f"<div><div>{title}{text}</div></div>", title + text)[k % 4]
        if k % 4 < 2:  # a page with an article: paragraphs beside it
            before.append(f"<div><p>{say(1, 60)}</p></div>")
            after.append(f"<section><h4>{say(1, 4)}</h4><p>{say(1, 60)}</p></section>")
        if k % 20 == 3:  # hardly any markup
            good.clear()
            main = main_text(3, 80)
            before, after = [], []
        some = "".join(x for x in before if rng.random() < 0.4), "".join(x for x in after if rng.random() < 0.4)
        pages.append((f"<html><head><title>{say(2, 5)}</title></head><body>{some[0]}{main}{some[1]}</body></html>", good))
    return pages


# ------------------------------------------------------------------- tree

MAX_DEPTH = 12
MIN_LEAF = 2


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0) -> tuple:
    """Leaf ``(bool,)`` or node ``(feature, cut, low, high)``, by Gini."""
    if depth == MAX_DEPTH or len(y) < 2 * MIN_LEAF or y.all() or not y.any():
        return (bool(y.mean() >= 0.5),)
    best = (0.0, -1, 0.0)
    base = len(y) * 2 * y.mean() * (1 - y.mean())
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, up = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = up[:-1], up[-1] - up[:-1]
        m = len(y) - n
        gini = 2 * left * (n - left) / n + 2 * right * (m - right) / m
        ok = (v[1:] > v[:-1]) & (n >= MIN_LEAF) & (m >= MIN_LEAF)
        if ok.any():
            i = int(np.where(ok, gini, np.inf).argmin())
            if base - gini[i] > best[0] + 1e-12:
                best = (base - gini[i], f, (v[i] + v[i + 1]) / 2)
    if best[1] < 0:
        return (bool(y.mean() >= 0.5),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth + 1), grow(x[~low], y[~low], depth + 1))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(node) == 1:
            out[rows] = node[0]
            continue
        low = x[rows, node[0]] <= node[1]
        todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def _fitted() -> tuple:
    xs, ys = [], []
    for page, good in labelled_pages():
        blocks = blocks_of(page)
        open_ones = np.array([not b.aside for b in blocks], dtype=bool)
        xs.append(block_features(blocks)[open_ones])
        ys.append(np.array([b.text in good for b in blocks], dtype=bool)[open_ones])
    return grow(np.concatenate(xs), np.concatenate(ys))


trained = Kept(_fitted)


def main_text(page: str | None, tree: tuple) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = judge(tree, block_features(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k and not b.aside)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with a string column ``main_text`` (or a longer free name)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = shared.value
        for htmls in batches:
            yield pd.Series([main_text(h, tree) for h in htmls], dtype=object)

    return pages.withColumn(fresh(pages, "main_text"), run(F.col(html_col)))
