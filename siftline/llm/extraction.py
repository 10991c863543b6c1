"""HTML extraction by tag-path ratios.

Every text block of a page has a root-to-leaf path of block elements, with the class of each. Per path the length of
text and the punctuation outside links are summed; their ratios to the number of blocks tell paths that hold prose from
paths that hold links and labels. Each ratio is smoothed over the page's order of paths, the two are fused to one, and
weighed down by what the elements say of themselves: a class that names an advert or comments, an article within an
article (a reader's comment, by HTML's own account), a place outside the page's article. A threshold on the fused ratio
picks the content paths, and their blocks are the content nodes. Short neighbours join them by position: headings,
list items and short paragraphs inside the content nodes' closest common ancestor, unless they too are weighed down.
Only what HTML itself declares to be no content never counts: nav, footer, aside, form and its parts, scripts, styles,
hidden elements, headers outside articles, and the roles that mean the same.

Defined results: a null or empty html, or one without text, gives an empty text; if no path is over the threshold, all
are content; paths with equal ratios are chosen alike; blocks that repeat are kept as often as they occur; rows with
equal ids are handled each by itself; other columns are ignored; empty tables give empty results. Time is linear in
the page's length, whatever its depth: paths are numbered once, and nothing walks the stack of open elements.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: elements by their role in HTML ---------------------------------------------------------------
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas select".split())
NEVER = frozenset("nav footer aside form button input label fieldset dialog menu search audio video map datalist optgroup option legend head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when one of these begins beside them.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}), "head": frozenset({"body"}),
}
#: A start tag closes an open element of the row above only up to these.
SCOPES = frozenset("html body table td th caption ul ol dl article section div main aside nav footer header form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist status".split())
#: Blocks that belong to the prose around them, however short.
AMONG = HEADINGS | frozenset("li dt dd blockquote pre td th figcaption".split())
#: Words of class names and ids that speak against a path; they lower its ratio, and decide nothing alone.
MARKS = frozenset(
    "ad ads advert advertisement advertising adsense banner promo promotion sponsored cookie cookies consent gdpr notice sidebar menu breadcrumb breadcrumbs comment comments "
    "respond replies newsletter subscribe signup popup modal pagination".split()
)
# ----------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡«»“”\"()–—]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_OPENS = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: What a mark, an article within an article, and a place outside the page's article or main part leave of a ratio.
MARKED, NESTED, OUTSIDE = 0.15, 0.15, 0.02


@dataclass(slots=True)
class Block:
    path: int
    node: int
    name: str  # of the element that holds it
    text: str
    in_link: int = 0


@dataclass(slots=True)
class Element:
    """An open element, with what is true of all that are open up to it."""

    name: str
    path: int
    node: int
    out: bool  # it, or one around it, is no part of an article
    blocks: int  # how many of them are blocks
    links: int
    articles: int


def _excluded(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether HTML itself says that this element is no content."""
    if name in NEVER or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return attributes.get("role", "").lower() in ROLES or bool(_HIDDEN.search(attributes.get("style", "")))


def _marked(name: str, attributes: dict[str, str]) -> bool:
    if name in ("html", "body", "main") or not attributes:
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return named != " " and not MARKS.isdisjoint(_WORDS.findall(_CAMEL.sub("-", named).lower()))


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        if value[:1] in "\"'":
            value = value[1:-1] if value[-1:] == value[:1] and len(value) > 1 else value[1:]
        out.setdefault(m[1].lower(), entities.unescape(value))
    return out


_CLOSES = {name: [k for k, v in CLOSED_BY.items() if name in v] for name in frozenset().union(*CLOSED_BY.values())}
_STOPS = {name: [s for s in SCOPES if name not in CLOSED_BY.get(s, ())] for name in _CLOSES}
_ROOT = Element("", 0, 0, False, 0, 0, 0)


@dataclass
class Page:
    """The blocks of a page, its paths (numbered; each with its weight and whether it lies in an article or main part),
    and the parent of every block element (by number)."""

    blocks: list[Block] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [1.0])
    inside: list[bool] = field(default_factory=lambda: [False])
    parents: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])


class _Reader:
    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[Element] = [_ROOT]
        self.places: dict[str, list[int]] = defaultdict(list)  # of each name, where on the stack it is open
        self.paths: dict[tuple[int, str], int] = {}
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if not self.parts:
            return
        top = self.stack[-1]
        text = " ".join("".join(self.parts).split())
        if text and not top.out:
            self.page.blocks.append(Block(top.path, top.node, self.page.names[top.node], text, self.linked))
        self.parts, self.linked = [], 0

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if top.out:
            return
        text = entities.unescape(text)
        self.parts.append(text)
        if top.links:
            self.linked += len(text.strip())

    def _cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def close(self, name: str) -> None:
        if not self.places[name]:
            return
        at = self.places[name][-1]
        top, this, below = self.stack[-1], self.stack[at], self.stack[at - 1]
        if name not in BLOCKS and top.blocks > this.blocks:
            return  # a stray end tag of an inline element doesn't close the blocks in it
        if top.blocks > below.blocks or top.out != below.out:
            self.flush()
        self._cut(at)

    def _last(self, names: list[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def open(self, name: str, raw: str) -> None:
        if name in _CLOSES:
            while (at := self._last(_CLOSES[name])) and at > self._last(_STOPS[name]):
                self.flush()
                self._cut(at)
        attributes = _attributes(raw) if "=" in raw or "hidden" in raw else {}
        top, is_block = self.stack[-1], name in BLOCKS
        out = top.out or _excluded(name, attributes, top.articles > 0)
        if is_block or out != top.out:
            self.flush()
        if name in VOID:
            if name == "br":
                self.parts.append(" ")
            return
        path, node = top.path, top.node
        if is_block and not out:
            path, node = self._enter(name, attributes, top)
        self.places[name].append(len(self.stack))
        self.stack.append(Element(name, path, node, out, top.blocks + is_block, top.links + (name == "a"), top.articles + (name in ("article", "main"))))

    def _enter(self, name: str, attributes: dict[str, str], top: Element) -> tuple[int, int]:
        page, marked = self.page, _marked(name, attributes)
        kind = attributes.get("class", "").split()
        label = f"{name}.{kind[0] if kind else ''}{'!' if marked else ''}"
        path = self.paths.get((top.path, label))
        if path is None:
            path = self.paths[top.path, label] = len(page.weights)
            nested = name == "article" and page.inside[top.path]
            page.weights.append(page.weights[top.path] * (MARKED if marked else 1.0) * (NESTED if nested else 1.0))
            page.inside.append(page.inside[top.path] or name in ("article", "main"))
        page.parents.append(top.node)
        page.names.append(name)
        return path, len(page.parents) - 1


def read(page: str) -> Page:
    """The text blocks of a page in order, without those inside elements that are never content."""
    state, at, n = _Reader(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            state.add(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if m is None:
            m = _LOOSE.match(page, lt)
        if lt > at:
            state.add(page[at:lt])
        if m is None:  # a lone <
            state.add("<")
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                state.parts.append(" ")
            state.close(name)
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            depth = 1
            nests = name in ("svg", "math", "object", "template", "noscript", "canvas", "select")
            if nests:
                while depth and (t := _OPENS[name].search(page, at)):
                    depth += -1 if t[1] else 0 if t[0].rstrip(">").endswith("/") else 1
                    at = t.end()
                if depth:
                    at = n
            else:
                end = _ENDS[name].search(page, at)
                at = end.end() if end else n
            continue
        state.open(name, m[3])
    state.flush()
    return state.page


def _smooth(values: list[float], weights: list[int], sigma: float = 1.0) -> list[float]:
    """A Gaussian over neighbours in the order of paths, weighed by how many blocks each path has."""
    reach = range(-2, 3)
    kernel = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in reach}
    out = []
    for i in range(len(values)):
        near = [(kernel[d] * weights[i + d], values[i + d]) for d in reach if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_scores(page: Page) -> dict[int, float]:
    """The fused ratio of every tag path that holds a block."""
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    for b in page.blocks:
        length[b.path] += max(0, len(b.text) - b.in_link)
        marks[b.path] += len(_PUNCTUATION.findall(b.text)) * (b.in_link * 2 <= len(b.text))
        count[b.path] += 1
    paths = list(count)
    text_ratio = [length[p] / count[p] for p in paths]
    mark_ratio = [(marks[p] + 0.1) / count[p] for p in paths]
    smooth = [_smooth(ratio, [count[p] for p in paths]) for ratio in (text_ratio, mark_ratio)]
    fused = [math.sqrt(t * m * st * sm) for t, m, st, sm in zip(text_ratio, mark_ratio, *smooth)]
    has_article = any(page.inside[p] for p in paths)
    return {p: v * page.weights[p] * (OUTSIDE if has_article and not page.inside[p] else 1.0) for p, v in zip(paths, fused)}


def content_paths(page: Page, scores: dict[int, float], threshold: float) -> set[int]:
    """Paths whose fused ratio is at least ``threshold`` times that of the mean character."""
    size = sum(len(b.text) for b in page.blocks)
    mean = sum(scores[b.path] * len(b.text) for b in page.blocks) / size
    return {p for p, v in scores.items() if v >= threshold * mean} or set(scores)


def _ancestor(page: Page, nodes: list[int]) -> list[bool]:
    """Of every block element whether it is the closest common ancestor of ``nodes`` or lies in it; that one first."""
    held = [0] * len(page.parents)
    for n in nodes:
        held[n] += 1
    root = 0
    for n in range(len(held) - 1, 0, -1):  # children have larger numbers than their parents
        if held[n] == len(nodes):
            root = n
            break
        held[page.parents[n]] += held[n]
    while page.names[root] in AMONG or page.names[root] == "p":
        root = page.parents[root]
    inside = [False] * len(held)
    inside[root] = True
    for n in range(root + 1, len(held)):
        inside[n] = inside[page.parents[n]]
    return inside


def main_text(html: str | None, threshold: float = 0.25) -> str:
    """The page's article: its blocks, joined by line breaks."""
    page = read(html or "")
    if not page.blocks:
        return ""
    chosen = content_paths(page, path_scores(page), threshold)
    return "\n".join(b.text for b in _with_neighbours(page, chosen))


def _with_neighbours(page: Page, chosen: set[int]) -> list[Block]:
    """The content nodes and the blocks beside them that belong to them, in the page's order."""
    content = [b.path in chosen for b in page.blocks]
    inside = _ancestor(page, [b.node for b, is_content in zip(page.blocks, content) if is_content])
    root = inside.index(True)
    parents = {page.parents[b.node] for b, is_content in zip(page.blocks, content) if is_content}
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    while first and page.blocks[first - 1].name in HEADINGS and page.weights[page.blocks[first - 1].path] == 1:
        first -= 1
    whole = page.names[root] in ("article", "main")
    out = []
    for i, (b, is_content) in enumerate(zip(page.blocks, content)):
        joins = inside[b.node] and page.weights[b.path] == 1
        if joins and not whole:  # nothing but the ratios says where the article ends
            joins = first <= i <= last and 2 * b.in_link <= len(b.text) and (b.name in AMONG or page.parents[b.node] in parents)
        if is_content or joins:
            out.append(b)
    return out


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
