"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the tag path from the root to it, inline elements included. For each path the
text length and the punctuation marks of its nodes are summed; over the number of its nodes they are the text ratio and
the punctuation ratio of the path. Both are laid out along the page, smoothed with a Gaussian, and fused by the product of
their logarithms; the mean over a path's nodes, times the weight of its names, is the path's score. Paths with a score of at
least the threshold, taken from the spread of the scores along the page, are strong, those of at least ``WEAK`` of it weak.

Names only weigh: a path through a menu, header, footer, sidebar, form, or an element whose class or id says so counts
little, one through an article or main element more; a name does not count on an element that holds the article.

The article is the smallest element that holds nearly all text on strong paths, or the article element around it. Blocks
in it whose nodes lie, by their mean score, on strong or weak paths are kept in page order; so an article keeps its short
lines and lists, and loses what scores like a menu. If no top heading is among them, the last one before them is kept.

White space inside a block, line breaks included, becomes one space.

Defined cases: a null or empty page and one without text give an empty text; a page without a path that scores gives an
empty text; broken and cut-off markup is read as far as it goes; repeated rows each have their own result; an empty table
gives an empty result; further columns are ignored. A page is read in one pass; the work is linear in its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td template tfoot th thead tr ul noscript button object svg canvas video audio".split()
)
#: Elements that end an open p.
ENDS_P = BLOCK - frozenset("caption legend optgroup option td th tr tbody thead tfoot button object svg canvas video audio noscript template".split())
#: An element of the first kind ends an open one of the second, up to one of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Not shown as text.
UNSHOWN = frozenset("head script style noscript template select textarea svg canvas object iframe title video audio".split())
#: Elements that weigh a path down, and those that weigh it up.
LOW = frozenset("nav header footer aside form button menu dialog".split())
HIGH = frozenset("article main".split())
#: Names of elements that are no article, wherever they stand, and of such that may also be a paragraph's own style.
NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|"
    r"sidebar|widget\w*|foot(?:er)?|masthead|comments?\w*|respond|disqus|replies|reply|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscribe|signup|login|pagination|pager|toolbar)(?=$|[\s_\d-])",
    re.I,
)
STYLE = re.compile(r"(?:^|[\s_-])(?:notices?|alert|side|aside|rail|head(?:er)?|copyright|search|skip)(?=$|[\s_\d-])", re.I)
#: Names that tell of a page's state, or of an article's own head, and not what an element is.
STATE = re.compile(r"(?<!\S)(?:(?:has|no|with|without|not)-\S*|\S*-(?:open|opened|closed|enabled|disabled|on|off)|(?:entry|post|article|story|content)-(?:head|header))(?!\S)", re.I)
HEAD = re.compile(r"(?<![^\s_-])head(?:er)?(?![^\s_\d-])", re.I)
#: Single blocks of text.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold an article.
HOLDERS = frozenset("#root html body main article section div td center details figure blockquote fieldset form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Weights of a path through such elements: low and high tags, names, links outside of headings, and text that stands in a division without an element of its own.
W_LOW, W_HIGH, W_NAME, W_LINK, W_BARE = 0.001, 4.0, 0.001, 0.02, 0.25
#: Share of the threshold that a path inside of the article needs, and share of the strong text that the article holds.
WEAK, MOST = 0.05, 0.9
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：¿¡]")


@dataclass
class Element:
    tag: str
    path: str
    at: int
    shown: bool
    weight: float
    hints: tuple[int, ...] = ()
    article: int = 0
    block: str = "#root"
    link: bool = False


@dataclass
class Node:
    """A run of text: its number of characters and punctuation marks, and the number of its block."""

    path: str
    chars: int
    marks: int
    block: int
    weight: float
    hints: tuple[int, ...]


@dataclass
class Block:
    """A block of text: its element's tag, the elements around it that may hold an article, and its outermost article or main element."""

    text: str
    tag: str
    holders: tuple[int, ...]
    hints: tuple[int, ...]
    low: bool
    article: int
    around: tuple[int, ...]
    nodes: list[Node] = field(default_factory=list)


def hinted(attributes: str, inside: bool, line: bool) -> bool:
    """Whether a class or id names a part that is no article; inside of one, a head is the article's own."""
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            value = STATE.sub("", "".join(values))
            if NAME.search(value) or not line and STYLE.search(HEAD.sub("", value) if inside else value):
                return True
    return False


def stated(attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its role is that of a low tag."""
    low = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False
        low = low or name == "role" and value.lower() in ROLES
    return False, low


def named(tag: str, attributes: str) -> str:
    return tag + "".join("." + "-".join("".join(v).split()[:1]) for n, *v in ATTRIBUTE.findall(attributes) if n.lower() == "class") if attributes else tag


def blocks_of(page: str) -> list[Block]:
    """The blocks of text in page order, each with its text nodes."""
    stack: list[Element] = [Element("#root", "", 0, True, 1.0)]
    out: list[Block] = []
    parts: list[str] = []
    nodes: list[Node] = []
    seen, at, low = 1, 0, None

    def text(run: str) -> None:
        run = html.unescape(run) if "&" in run else run
        parts.append(run)
        slim = " ".join(run.split())
        top = stack[-1]
        if slim and top.shown:
            nodes.append(Node(top.path, len(slim), len(PUNCTUATION.findall(slim)), len(out), top.weight * (W_LINK if top.link and top.block not in HEADINGS else 1) * (1 if top.block in LINES else W_BARE), top.hints))

    def flush() -> None:
        if parts:
            t = " ".join("".join(parts).split())
            parts.clear()
            top = stack[-1]
            if t and top.shown:
                around = tuple(e.at for e in stack if top.article and e.at <= top.article)
                of = tuple(e.at for e in stack if e.tag in HOLDERS)
                out.append(Block(t, top.block, of, top.hints, top.weight < 1, top.article, around, list(nodes)))
            nodes.clear()

    def close(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                flush()
                del stack[k:]
                # of an outer one too, as a row ends its cells
                return close(names, until)
            if stack[k].tag in until:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(e.tag in BLOCK for e in stack[k:]):
                        flush()
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK or stack[k].tag in ("article", "table", "td", "body") and tag == "p":
                    break
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                close(("p",), ("article", "table", "td", "th", "div", "section", "main", "body", "button", "object"))
            if tag in ENDS:
                close(*ENDS[tag])
        if tag in VOID:
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            if tag not in BLOCK:
                close_at = page.find(">", at)
                at = len(page) if close_at < 0 else close_at + 1
            continue
        if attributes.rstrip().endswith("/") and attributes.rstrip()[-2:-1] in ("", " ", '"', "'") and tag not in BLOCK:
            continue
        top, outer = stack[-1], tag in ("html", "body")
        hide, role = stated(attributes) if attributes and not outer else (False, False)
        shown = top.shown and tag not in UNSHOWN and not hide
        # the header of an article is its own, and forms may wrap a page: they count as a name
        down = role or tag in LOW and tag != "form" and not (tag == "header" and top.article)
        weight = top.weight * (W_LOW if down else 1) * (W_HIGH if tag in HIGH and not top.article else 1)
        hint = tag == "form" or bool(attributes and not outer and hinted(attributes, bool(top.article), tag in LINES))
        hints = top.hints + (seen,) if hint else top.hints
        article = top.article or (seen if tag in HIGH else 0)
        block = tag if tag in BLOCK else top.block
        stack.append(Element(tag, f"{top.path}/{named(tag, attributes)}", seen, shown, weight, hints, article, block, top.link or tag == "a"))
        seen += 1
    flush()
    return out


def spared(blocks: list[Block]) -> set[int]:
    """The numbers of the elements whose names do not count, for they hold the article.

    They are those around the one article or main element that stands in no named element or has over half the text of
    all of them, else around the longest; on a page without these, the ones that hold nearly all the text.
    """
    if not any(b.hints for b in blocks):
        return set()
    open_ = [b for b in blocks if not b.low]
    articles: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in open_:
        if b.article:
            articles[b.article][0] += len(b.text)
            articles[b.article][1] += len(b.text) * (not b.hints)
    if articles:
        top = max(articles, key=lambda k: articles[k][0])
        if any(free for _, free in articles.values()) and 2 * articles[top][0] <= sum(n for n, _ in articles.values()):
            return set()
        return set(next(b.around for b in open_ if b.article == top))
    held: dict[int, int] = defaultdict(int)
    for b in open_:
        for h in b.hints:
            held[h] += len(b.text)
    return {h for h, n in held.items() if n >= MOST * sum(len(b.text) for b in open_)}


def smoothed(v: np.ndarray, sigma: float) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-np.square(np.arange(-reach, reach + 1)) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(v)), kernel, "full")[reach : reach + len(v)]
    return np.convolve(v, kernel, "full")[reach : reach + len(v)] / weight


def path_scores(nodes: list[Node], free: set[int], sigma: float) -> tuple[list[float], float]:
    """The score of each node's path, and the threshold."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0])
    for n in nodes:
        s = sums[n.path]
        s[0] += n.chars
        s[1] += n.marks
        s[2] += 1
    length = smoothed(np.array([sums[n.path][0] / sums[n.path][2] for n in nodes]), sigma)
    marks = smoothed(np.array([sums[n.path][1] / sums[n.path][2] for n in nodes]), sigma)
    fused = np.log1p(length) * (1 + np.log1p(marks))
    weight = np.array([n.weight * (1 if all(h in free for h in n.hints) else W_NAME) for n in nodes])
    total: dict[str, float] = defaultdict(float)
    for n, v in zip(nodes, fused * weight, strict=True):
        total[n.path] += float(v)
    scores = [total[n.path] / sums[n.path][2] for n in nodes]
    return scores, min(float(np.std(scores)), max(scores) / 2)


def main_text(page: str, sigma: float = 0.7) -> str:
    blocks = blocks_of(page)
    nodes = [n for b in blocks for n in b.nodes]
    if not nodes:
        return ""
    scores, edge = path_scores(nodes, spared(blocks), sigma)
    worth, at = [], 0
    for b in blocks:
        part = scores[at : at + len(b.nodes)]
        at += len(b.nodes)
        worth.append(sum(s * n.chars for s, n in zip(part, b.nodes, strict=True)) / max(1, sum(n.chars for n in b.nodes)))
    strong = [b for b, w in zip(blocks, worth, strict=True) if w >= edge]
    held: dict[int, int] = defaultdict(int)
    for b in strong:
        for h in b.holders:
            held[h] += len(b.text)
    most = MOST * sum(len(b.text) for b in strong)
    holder = max(h for h, n in held.items() if n >= most)
    articles = [b.article for b in strong if holder in b.holders]
    if articles and articles[0] and all(a == articles[0] for a in articles):
        holder = min(holder, articles[0])
    kept = [k for k, (b, w) in enumerate(zip(blocks, worth, strict=True)) if holder in b.holders and w >= WEAK * edge]
    if not any(blocks[k].tag == "h1" for k in kept):
        kept = [k for k in range(kept[0]) if blocks[k].tag == "h1"][-1:] + kept
    return "\n".join(blocks[k].text for k in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [main_text(b.decode()) for b in T.texts(batch.column("html"))]
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": pa.array(found, pa.string()),
            "n_chars": pa.array([len(t) for t in found], pa.int64()),
        }

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return T.per_batch(slim, run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
