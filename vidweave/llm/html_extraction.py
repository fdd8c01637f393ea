"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Each node is content or boilerplate; it has unary features (its tag, words
in its class, id and role, the length, link share and sentence marks of its text, its place), and each pair of
parent and child has a potential that depends on the kind of the child. Sum-product messages go from the leaves
up and from the root down once, which gives the exact marginal of every node. The weights maximise the
likelihood of labelled pages (gradient: labels less marginals); labelled pages are HTML in which elements
carry data-y="1" or "0", inherited by what is inside. The pages given by `labelled_pages` are made by rule from
common page layouts, so a model needs no other data; own ones can be given to `train`.

Pages are parsed and inferred in the tasks that read them, some megabytes at a time as one forest; the model
(under 200 numbers) goes with the task. No page meets another one, so there is no shuffle.

Text: character references are decoded; scripts, styles, comments and the head are not rendered; white space
in a block, line breaks included, becomes one space; kept blocks are joined by line feeds in page order.

Defined results: a null or empty page has an empty text. Broken markup is closed as browsers do in the common
cases (a new paragraph ends an open one; a body, or anything that cannot stand in a head, ends a head left open, and
likewise a select; a rule ends the block before it; unknown end tags are ignored). A null id stays null. Rows are independent: repeated rows
give repeated results, and an empty table an empty one. Columns other than the three named ones are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript title svg iframe textarea select".split())
#: What may stand in a head; anything else ends a head that was left open, as a body does.
_IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: What an open select may hold; a start tag of another kind ends it.
_IN_SELECT = frozenset("option optgroup hr script template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}}
#: Words in class, id and role that name a part of a page.
_NAMES = (
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|tabs?|toc",
    r"header|masthead|banner|topbar|logo|branding",
    r"footer|foot|copyright|legal|contentinfo|bottom",
    r"sidebar|side|aside|related|widget|trending|recommended|popular|complementary|rail|more",
    r"ad|ads|advert|advertisement|sponsor|sponsored|promo|promoted|banner-ad|adsense",
    r"cookie|cookies|notice|consent|alert|popup|modal|gdpr|privacy|message|warning|toast|overlay",
    r"form|newsletter|subscribe|signup|login|search|subscription|share|social|sharing",
    r"comment|comments|commentlist|reply|replies|respond|discussion|disqus|responses|reviews",
    r"article|content|main|post|entry|story|body|text|page|articlebody|prose|maincontent",
)
_NAME_PATTERNS = [re.compile(rf"(?:^|[\s_-])(?:{n})(?:$|[\s_-])") for n in _NAMES]
_TAGS = ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "td", "table", "blockquote", "pre", "form", "nav", "aside", "footer", "header", "figure", "figcaption", "dl", "dd", "body")
_TAG_PLACE = {t: k for k, t in enumerate(_TAGS)}
N_UNARY = len(_TAGS) + len(_NAMES) + 9
#: Kinds of children for the pair potentials.
_KINDS = ({"p", "blockquote", "pre", "dd", "dt", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"li", "ul", "ol", "dl", "td", "tr", "tbody", "table"}, {"nav", "aside", "footer", "header", "form"})
N_KINDS = len(_KINDS) + 1


class Tree(HTMLParser):
    """The block elements of a page, their own text, and its runs in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.names, self.parents, self.labels = ["html"], [""], [-1], [-1]
        self.runs: list[tuple[int, list[str]]] = []
        self.link_chars = [0]
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._within: list[str] = []  # open elements that are not rendered
        self._head = self._begun = False
        self._links = 0
        self._open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._within and self._within[-1] == "select" and tag not in _IN_SELECT:
            self._within.pop()
            if tag == "select":  # a second one ends the first
                return
        if self._within and self._within[-1] == "svg" and tag in _BLOCK:
            self._within.pop()
        if self._within:
            if tag in _HIDDEN:
                self._within.append(tag)
            return
        if tag == "head":
            self._head = not self._begun
            return
        if self._head and tag not in _IN_HEAD and tag != "html":
            self._head = False
        self._begun = self._begun or tag not in _IN_HEAD | {"html"}
        if tag in _VOID:
            if tag in ("br", "img"):
                self._text(" ")
            elif tag == "hr":
                self._close({"p"}, _BLOCK - {"p"})
                self._open = False
            return
        if tag in _HIDDEN:
            self._within.append(tag)
            return
        if tag in ("html", "body"):
            return
        if tag in _ENDS_P:
            self._close({"p"}, _BLOCK - {"p"})
        if tag in _SAME:
            self._close(_SAME[tag], _HOLDS[tag])
        if tag in _BLOCK:
            given = {k: v or "" for k, v in attrs}
            parent = self._stack[-1][1]
            self.tags.append(tag)
            self.names.append(" ".join(given.get(k, "") for k in ("class", "id", "role")).lower())
            self.parents.append(parent)
            self.labels.append(int(given["data-y"]) if given.get("data-y") in ("0", "1") else self.labels[parent])
            self.link_chars.append(0)
            self._stack.append((tag, len(self.tags) - 1))
            self._open = False
        else:
            if tag == "a":
                self._links += 1
            self._stack.append((tag, self._stack[-1][1]))

    def _close(self, tags: set, stop: set | frozenset) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[k][0]
            if tag in tags:
                self._cut(k)
                return
            if tag in stop:
                return

    def _cut(self, k: int) -> None:
        for tag, _ in self._stack[k:]:
            if tag in _BLOCK:
                self._open = False
            if tag == "a":
                self._links -= 1
        del self._stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if self._within:
            if tag in self._within:  # and what was left open inside it
                del self._within[self._within.index(tag) :]
            return
        if tag == "head":
            self._head = False
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                self._cut(k)
                return
            if tag not in _BLOCK and self._stack[k][0] in _BLOCK:
                return

    def _text(self, data: str) -> None:
        if self._within or (self._head and not data.strip()):
            return
        self._head = False  # text ends a head that was left open
        node = self._stack[-1][1]
        if not self._open:
            self.runs.append((node, []))
            self._open = True
        self.runs[-1][1].append(data)
        if self._links:
            self.link_chars[node] += len(data)

    def handle_data(self, data: str) -> None:
        self._text(data)


def parse(page: str) -> Tree:
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.runs = [(node, text) for node, parts in tree.runs if (text := " ".join("".join(parts).split()))]
    return tree


def _has_name(names: str) -> list[int]:
    return [k for k, p in enumerate(_NAME_PATTERNS) if p.search(names)] if names.strip() else []


def unary(tree: Tree) -> np.ndarray:
    n = len(tree.tags)
    out, base = np.zeros((n, N_UNARY)), len(_TAGS) + len(_NAMES)
    own, marks, first = np.zeros(n), np.zeros(n), np.full(n, 1.0)
    total = max(1, len(tree.runs))
    for k, (node, text) in enumerate(tree.runs):
        own[node] += len(text)
        marks[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        first[node] = min(first[node], k / total)
    links = np.minimum(np.array(tree.link_chars, float), own)
    below, below_links = own.copy(), links.copy()
    for k in range(n - 1, 0, -1):
        below[tree.parents[k]] += below[k]
        below_links[tree.parents[k]] += below_links[k]
    for k in range(n):
        if (place := _TAG_PLACE.get(tree.tags[k])) is not None:
            out[k, place] = 1
        for name in _has_name(tree.names[k]):
            out[k, len(_TAGS) + name] = 1
    out[:, base] = np.log1p(own) / 5
    out[:, base + 1] = links / np.maximum(1, own)
    out[:, base + 2] = below_links / np.maximum(1, below)
    out[:, base + 3] = np.minimum(1, marks / np.maximum(1, own) * 20)
    out[:, base + 4] = (own > 0) & (own < 40)
    out[:, base + 5] = own > 150
    out[:, base + 6] = below / max(1, below[0])
    out[:, base + 7] = own == 0
    out[:, base + 8] = 1
    return out


def kinds(tree: Tree) -> np.ndarray:
    return np.array([next((k for k, tags in enumerate(_KINDS) if t in tags), N_KINDS - 1) for t in tree.tags])


class Forest:
    """Trees side by side, with their nodes by depth."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = np.array([len(t.tags) for t in trees])
        self.starts = np.cumsum(sizes) - sizes
        self.x = np.concatenate([unary(t) for t in trees])
        self.kind = np.concatenate([kinds(t) for t in trees])
        self.parent = np.concatenate([np.where(np.array(t.parents) < 0, -1, np.array(t.parents) + s) for t, s in zip(trees, self.starts, strict=True)])
        depths: list[int] = []
        for p in self.parent.tolist():
            depths.append(depths[p] + 1 if p >= 0 else 0)
        depth = np.array(depths)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint of (parent, child) of each node that has a parent.
        pair: log potentials by kind, parent label, child label."""
        score = self.x @ w
        up = np.stack([np.zeros(len(score)), score], 1)  # log belief from below
        message = np.zeros_like(up)  # to the parent, by the parent's label
        for level in reversed(self.levels):
            m = np.logaddexp(*(pair[self.kind[level], :, c] + up[level, c][:, None] for c in (0, 1)))
            m -= m.max(1, keepdims=True)
            message[level] = m
            np.add.at(up, self.parent[level], m)
        full, joint = up.copy(), np.zeros((len(score), 2, 2))
        for level in self.levels:
            at = self.parent[level]
            rest = full[at] - message[level]
            both = rest[:, :, None] + pair[self.kind[level]] + up[level][:, None, :]
            both -= both.max((1, 2), keepdims=True)
            joint[level] = np.exp(both) / np.exp(both).sum((1, 2), keepdims=True)
            down = np.logaddexp(*(pair[self.kind[level], p, :] + rest[:, p][:, None] for p in (0, 1)))
            full[level] = up[level] + down - down.max(1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50))), joint


def train(pages: list[str], steps: int = 250, rate: float = 0.1, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and pair log potentials from labelled pages."""
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    y = np.clip(np.concatenate([t.labels for t in trees]), 0, 1)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    theta = np.zeros(N_UNARY + N_KINDS * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, joint = forest.marginals(theta[:N_UNARY], theta[N_UNARY:].reshape(N_KINDS, 2, 2))
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[child], joint[child])
        grad = np.concatenate([forest.x.T @ (p - y), (expected - seen).ravel()]) / len(trees) + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:N_UNARY], theta[N_UNARY:].reshape(N_KINDS, 2, 2)


def labelled_pages(n: int = 320, seed: int = 5) -> list[str]:
    """Pages of common layouts with labelled parts, made by rule."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "to", "rin", "el", "mos", "ta", "vu", "sen", "or", "pli")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    style = {"ends": (".",), "most": 7, "words": (3, 18)}
    sentence = lambda: words(*style["words"]).capitalize() + rng.choice(style["ends"]) + " "
    prose = lambda: "".join(sentence() for _ in range(rng.randint(1, style["most"])))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda: f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(3, 9)))}</ul>"
    cls = lambda *names: f'{rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'

    def box(tag: str, attr: str, inner: str, y: int) -> str:
        return f'<{tag} {attr} data-y="{y}">{inner}</{tag}>'

    def body_part() -> str:
        kind = rng.random()
        if kind < 0.66:
            return f"<p>{rng.choice(('', '', '<b>'))}{prose()}{rng.choice(('', '<br>' + prose()))}</p>" if rng.random() < 0.8 else f"<p><b>{prose()}<br>"
        if kind < 0.76:
            return f"<h{(k := rng.randint(2, 3))}>{words(2, 7)}</h{k}>"
        if kind < 0.84:
            return f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind < 0.94:
            return f"<p>{sentence()} {link()} {sentence()}</p>"
        if kind < 0.97:
            return f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>"
        return f"<p>{words(1, 4)}.</p>"

    def boiler(where: str) -> str:
        makers = {
            "top": (
                lambda: box("nav", rng.choice(("", cls("nav", "menu", "main-menu"))), links(), 0),
                lambda: box("div", cls("menu", "navbar", "nav", "topbar", "breadcrumbs"), links(), 0),
                lambda: box("header", rng.choice(("", cls("header", "masthead", "site-header"))), f"<div>{words(1, 4)}</div>" + rng.choice(("", links(), f"<h1>{words(1, 3)}</h1>", f"<p>{sentence()}</p>")), 0),
                lambda: box("div", cls("header", "site-header", "banner"), words(1, 6), 0),
                lambda: box("div", cls("cookie-notice", "notice", "alert", "consent", "gdpr-popup"), f"<p>{prose()}</p>", 0),
            ),
            "any": (
                lambda: box("div", cls("ad", "ads", "advert", "sponsored", "promo"), prose() if rng.random() < 0.7 else f"<p>{prose()}</p>", 0),
                lambda: box("aside", rng.choice(("", cls("sidebar", "related"))), rng.choice((links(), f"<h3>{words(1, 3)}</h3><p>{prose()}</p>", f"<p>{prose()}</p>")), 0),
                lambda: box("form", rng.choice(("", cls("newsletter", "search", "subscribe"))), f"<label>{words(1, 4)}</label><input><button>{word()}</button><p>{sentence()}</p>", 0),
                lambda: box("div", cls("share", "social", "newsletter", "related-posts"), rng.choice((links(), words(2, 8), f"<p>{sentence()}</p>")), 0),
                lambda: box("div", cls("notice", "cookie", "modal", "popup"), rng.choice((prose(), f"<p>{prose()}</p>")), 0),
            ),
            "end": (
                lambda: box("div", cls("sidebar", "side", "widget", "related", "trending"), rng.choice((links(), f"<h4>{words(1, 3)}</h4><p>{prose()}</p>")), 0),
                lambda: box("footer", rng.choice(("", cls("footer", "site-footer"))), rng.choice((f"&copy; {word()} &middot; {sentence()}", f"<p>{prose()}</p>", links())), 0),
                lambda: box("div", cls("footer", "copyright", "site-footer", "legal"), rng.choice((words(3, 9), f"<p>{prose()}</p>")), 0),
                lambda: box(rng.choice(("section", "div")), cls("comments", "comment-list", "replies", "discussion"), f"<h3>{words(1, 2)}</h3>" + "".join(f'<{(t := rng.choice(("div", "article", "li")))} class="comment"><p>{prose()}</p></{t}>' for _ in range(rng.randint(1, 5))), 0),
            ),
        }
        return rng.choice(makers[where])()

    pages = []
    for _ in range(n):
        style["ends"] = rng.choice(((".", ".", ",", "?"), (".", ".", ",", "!"), ("",), ("***", " |", "%%%")))
        style["most"] = rng.choice((1, 1, 2, 4, 8))
        style["words"] = rng.choice(((1, 3), (1, 7), (3, 18), (3, 18)))
        title = f"<h{(k := rng.choice((1, 1, 1, 2)))}>{words(1, 9)}</h{k}>"
        title = f"<header>{title}</header>" if rng.random() < 0.15 else title
        parts = [title] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14, 40))):
            parts.append(body_part())
            if rng.random() < 0.06:
                parts.append(boiler("any"))
        tag, attr = rng.choice((("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", cls("content", "main", "article-body", "post", "entry-content", "story")), ("section", cls("content", "article", "main-content"))))
        main = box(tag, attr, "".join(parts), 1)
        if rng.random() < 0.25:
            main = f'<{(t := rng.choice(("div", "main", "section")))} data-y="1">{main}</{t}>'
        before = "".join(boiler(rng.choice(("top", "top", "any"))) for _ in range(rng.randint(1, 3)))
        after = "".join(boiler(rng.choice(("end", "end", "any"))) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            before, after = f'<div class="{rng.choice(("wrapper", "container", "page"))}">{before}', f"{after}</div>"
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{before}{main}{after}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def main_text(trees: list[Tree], model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> list[str]:
    if not trees:
        return []
    forest = Forest(trees)
    content, _ = forest.marginals(*model)
    return ["\n".join(text for node, text in t.runs if content[start + node] >= threshold) for t, start in zip(trees, forest.starts, strict=True)]


def extract(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in slices(map(len, pdf["html"]), 2_000_000):
                part = pdf.iloc[a:b]
                texts = main_text([parse(h) for h in part["html"]], model, threshold)
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": list(map(len, texts))})

    # ids go as text: pandas would turn whole numbers with nulls among them into floats
    pages = df.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    out = pages.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
