"""Main text of web pages by boosted trees over the nodes of the page's element tree.

Each block-level element is a node with features of its subtree (text and link density, punctuation, counts of
parts), its tag, its class, id and role tokens and those above it, its depth, and how it compares with its
siblings and the page.  Boosted trees give each node the log-odds that its subtree has main text.  Decoding
then picks the likeliest consistent choice for the whole tree: whatever lies under a rejected node is rejected,
and a kept node may have rejected parts.

The trees are fitted once per process on pages made from a seeded generator of layouts, whose blocks are known
to be main text or not: no table has labels for pages.

Defined cases: a null or empty page has an empty text; text without any markup is main text; unclosed and
stray tags close as browsers close them; a quote begins a value only after an equals sign, and one that is never closed
is an ordinary letter; a line break is white space; pages of any length and depth are read in one pass; repeated rows
give repeated results; the words in svg and math are part of the text around them; noscript and object are nodes of
their own; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import gradient_trees, html_layouts

# Element names of the HTML standard, by how a reader treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe title textarea select button head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FOREIGN = frozenset(("svg", "math"))  # these and what lies in them may be closed by a slash
WITHIN = frozenset(("noscript", "object"))  # nodes that may lie in a paragraph
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Kinds of words in class, id and role attributes.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc tabs skip",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner outbrain taboola affiliate",
    "foot": "foot footer bottom copyright legal contentinfo colophon",
    "head": "head header masthead top topbar logo brand branding",
    "side": "side sidebar aside widget widgets related recommended popular trending teaser more rail complementary",
    "talk": "comment comments commentlist reply replies respond discussion disqus feedback reviews thread reader",
    "note": "cookie cookies consent notice alert popup modal overlay gdpr warning message toast privacy",
    "form": "form newsletter subscribe subscription signup login search share social sharing follow",
    "main": "main content article post entry story body text page prose hentry articlebody maincontent blog",
}
_HINT = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "body")
_TAG = {t: i for i, t in enumerate(TAGS)} | {"h3": 6, "h4": 6, "h5": 6, "h6": 6, "ol": 7, "dl": 7, "menu": 7, "dt": 8, "dd": 8, "th": 15, "tr": 14, "tbody": 14, "fieldset": 13, "html": 19, "figcaption": 18}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+)>?|<[!?/][^>]*>?""", re.S
)
_HINTED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile(r"\s+")
_STOPS = re.compile(r"[.,;:!?。、]")


@dataclass
class Node:
    """A block-level element; ``texts`` are its own blocks as (order on the page, text)."""

    tag: str
    parent: int
    depth: int
    hints: tuple[int, ...]
    texts: list[tuple[int, str]] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    images: int = 0


def hints_of(attributes: str) -> tuple[int, ...]:
    if "=" not in attributes:
        return ()
    found = set()
    for groups in _HINTED.findall(attributes):
        for word in _WORD.findall("".join(groups)):
            kind = _HINT.get(word.lower())
            if kind is not None:
                found.add(kind)
    return tuple(found)


class _Open:
    """The open elements, innermost last: their names, the nodes that take their text, and where each name stands."""

    def __init__(self) -> None:
        self.names, self.nodes = ["body"], [0]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are nodes

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCK or name in WITHIN:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.names.pop()].pop()
        self.nodes.pop()
        if self.blocks and self.blocks[-1] == len(self.names):
            self.blocks.pop()

    def last(self, names: tuple[str, ...]) -> int:
        """Where the innermost open element of these names stands; 0 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def within(self, names: tuple[str, ...], holders: tuple[str, ...]) -> int:
        """The same, not looking beyond the innermost of ``holders``."""
        found = self.last(names)
        return found if found >= self.last(holders) else 0

    def holds_nodes(self, to: int) -> bool:
        """Whether an element from place ``to`` on is a node."""
        return bool(self.blocks) and self.blocks[-1] >= to


def parse(page: str) -> list[Node]:
    """The page's nodes in page order; the first is an implicit root."""
    nodes = [Node("body", -1, 0, ())]
    stack = _Open()
    pieces: list[str] = []
    ends: dict[str, re.Match | None] = {}  # the next closing tag of a raw element, as far as it was searched for
    order, at = 0, 0

    def flush() -> None:
        nonlocal order
        if pieces:
            text = _BLANK.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                nodes[stack.nodes[-1]].texts.append((order, text))
                order += 1

    def close(to: int) -> None:
        """Close the open elements from place ``to`` on."""
        if stack.holds_nodes(to):
            flush()
        while len(stack.names) > to:
            stack.pop()

    def begin(name: str, attributes: str) -> None:
        """A node."""
        parent = stack.nodes[-1]
        nodes.append(Node(name, parent, nodes[parent].depth + 1, hints_of(attributes)))
        stack.push(name, len(nodes) - 1)

    def say(text: str) -> None:
        if text:
            pieces.append(text)
            if stack.places.get("a"):
                nodes[stack.nodes[-1]].linked += len(text.strip())

    def closing(name: str) -> re.Match | None:
        if name not in ends or (ends[name] is not None and ends[name].start() < at):
            ends[name] = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
        return ends[name]

    found = _TOKEN.search(page)
    while found:
        say(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            pass
        elif found[1]:
            to = stack.last((name,))
            if to and (name in BLOCK or not stack.holds_nodes(to + 1)):
                close(to)
            elif name == "p":
                flush()
        elif found[3].endswith("/") and (name in FOREIGN or stack.last(tuple(FOREIGN))):
            pass
        elif name in RAW:
            if name != "head":
                end = closing(name)
                at = end.end() if end else (len(page) if name in ("script", "style", "title", "textarea") else at)
                if not found[3].endswith("/"):
                    pieces.append(" ")
        elif name in VOID:
            pieces.append(" ")
            nodes[stack.nodes[-1]].images += name == "img"
            if name == "hr":
                flush()
        elif name in WITHIN:
            flush()
            begin(name, found[3])
        elif name in ("body", "html"):
            flush()
            nodes[0].hints = tuple({*nodes[0].hints, *hints_of(found[3])})
        elif name in BLOCK:
            flush()
            if to := stack.within(("p",), ("td", "th", "li", "blockquote", "table")):
                close(to)
            if to := stack.within(CLOSES.get(name, ()), HOLDERS.get(name, ())):
                close(to)
            begin(name, found[3])
        else:
            stack.push(name, stack.nodes[-1])
            nodes[stack.nodes[-1]].links += name == "a"
        found = _TOKEN.search(page, at)
    say(page[at:])
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n, kinds = len(nodes), len(HINTS)
    parent = np.array([x.parent for x in nodes])
    own = np.zeros((n, 7))  # characters, linked characters, links, stops, blocks, elements, images
    for i, x in enumerate(nodes):
        size = stops = 0
        for _, t in x.texts:
            size += len(t)
            stops += len(_STOPS.findall(t))
        own[i] = size, min(x.linked, size), x.links, stops, len(x.texts), 1, x.images
    total = own.copy()
    paragraphs = np.array([float(x.tag == "p") for x in nodes])
    place, count, same = np.zeros(n), np.zeros(n), np.zeros(n)
    children: list[dict[str, int]] = [{} for _ in nodes]
    for i in range(1, n):
        place[i] = count[parent[i]]
        count[parent[i]] += 1
        children[parent[i]][nodes[i].tag] = children[parent[i]].get(nodes[i].tag, 0) + 1
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        paragraphs[parent[i]] += paragraphs[i]
        same[i] = children[parent[i]][nodes[i].tag]
    before = np.concatenate([[0], np.cumsum(own[:-1, 0])])
    hint, above = np.zeros((n, kinds)), np.zeros((n, kinds))
    tag, tag_above = np.zeros((n, len(TAGS))), np.zeros((n, len(TAGS)))
    for i, x in enumerate(nodes):
        for k in x.hints:
            hint[i, k] = 1
        if x.tag in _TAG:
            tag[i, _TAG[x.tag]] = 1
        if i:
            above[i] = np.maximum(above[x.parent], hint[x.parent])
            tag_above[i] = np.maximum(tag_above[x.parent], tag[x.parent])
    size = total[:, 0]
    page = max(size[0], 1)
    up = np.maximum(size[np.maximum(parent, 0)], 1)
    siblings = np.maximum(count[np.maximum(parent, 0)], 1)
    numbers = np.stack(
        [
            np.log1p(size), size / page, size / up, total[:, 1] / np.maximum(size, 1), np.log1p(total[:, 2]), total[:, 3] / np.maximum(size, 1),
            np.log1p(size / np.maximum(total[:, 4], 1)), np.log1p(total[:, 5]), size / total[:, 5], np.log1p(paragraphs), np.log1p(total[:, 6]),
            np.array([x.depth for x in nodes], float), place, place / siblings, np.log1p(siblings), np.log1p(same), before / page, np.log1p(own[:, 0]),
            size * siblings / up, total[np.maximum(parent, 0), 1] / up,
        ],
        axis=1,
    )
    return np.concatenate([numbers, hint, above, tag, tag_above], axis=1)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept nodes in which nothing below a rejected node is kept."""
    n = len(nodes)
    weight = np.zeros(n)
    keep, drop = np.zeros(n), np.zeros(n)
    filled = np.zeros(n, bool)
    for i in range(n - 1, -1, -1):
        filled[i] |= bool(nodes[i].texts)
        weight[i] = odds[i] if filled[i] else 0.0
        keep[i] += weight[i]
        drop[i] -= weight[i]
        if i:
            p = nodes[i].parent
            filled[p] |= filled[i]
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
    kept = np.zeros(n, bool)
    kept[0] = keep[0] >= drop[0] or n == 1
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and keep[i] >= drop[i]
    return kept


@lru_cache(1)
def model(pages: int = 400, seed: int = 7) -> gradient_trees.Trees:
    """Trees fitted to generated pages; a node is positive if its subtree has main text."""
    rows, target = [], []
    for page in html_layouts.pages(pages, seed):
        nodes = parse(page)
        main = np.array([any(html_layouts.is_main(t) for _, t in x.texts) for x in nodes])
        filled = np.array([bool(x.texts) for x in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] |= main[i]
            filled[nodes[i].parent] |= filled[i]
        rows.append(features(nodes)[filled])
        target.append(main[filled])
    return gradient_trees.fit(np.concatenate(rows), np.concatenate(target).astype(float))


def main_texts(pages: list[str], trees: gradient_trees.Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    odds = trees.log_odds(np.concatenate([features(nodes) for nodes in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for _, t in sorted(block for i, x in enumerate(nodes) if kept[i] for block in x.texts)))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, in one pass without a shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
