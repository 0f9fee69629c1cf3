"""Main-text extraction from web pages by tag-path ratios.

Every text node has a tag path, the tags (with class and id words) from the root down to it. Text
lengths, punctuation marks and link characters are summed per path, so that the many short nodes of
a menu and the few long ones of an article each speak with one voice. A path's text ratio
(characters a node) and punctuation ratio (marks a node) are smoothed over the sequence of nodes
with a Gaussian window and saturate, so that one endless paragraph outweighs no article. They are
fused as a product, discounted by the share of link text and by priors of the tags and names above
the node, and averaged over the path: paths above a threshold are content.

The region is the deepest element that holds all content nodes. What stands in it and belongs to no
content path (a heading, a short list, a caption) stays too, unless the block it stands in holds no
content at all and looks like furniture: its prior is low or, outside an article, it is mostly links.

Tags and names are evidence in the score and no verdict. Names that often head a section of an
article (related, legal, discussion) count only outside of article and main, names in the negative
(no-sidebar, has-sidebar) not at all, and none counts for an element that holds the article.

One page is one row and small; pages are spread over tasks by Spark. Work is linear in the page:
paths are numbered as they open, and sums over subtrees take one pass over the elements.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
NEVER = frozenset("script style noscript template iframe object svg canvas audio video map head title select option datalist button textarea annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of formulas; they stand within a line.
INLINE |= frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle mpadded mfenced menclose semantics".split())
#: Skipped elements that stand within a line, so that text on either side is one block.
WITHIN = frozenset("script style noscript template iframe object svg canvas audio video map select button textarea datalist annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold furniture, with the prior of what stands in them.
FURNITURE, FURNITURE_PRIOR = frozenset("nav footer aside dialog menu form fieldset".split()), 0.02
#: Words of a class, id or role: the first kind names furniture anywhere, the second outside of article and main only.
STRONG = re.compile(r"(?:ads?|advert\w*|sponsor\w*|banner|cookies?|consent|gdpr|popup|modal|newsletter|paywall|sharing|sidebar|nav|navbar|navigation|menu|breadcrumbs?|toolbar|pager|pagination|masthead|footer|copyright|comments?|commentlist|disqus|respond|repl(?:y|ies)|contentinfo|complementary)")
#: Of the first kind, words that an article may use for a section of its own: prose under them stays.
OWN = re.compile(r"(?:banner|nav|navbar|navigation|menu|toolbar|pager|pagination|copyright)")
WEAK = re.compile(r"(?:promo\w*|notices?|alert|overlay|subscri\w*|signup|share|social|related|recommend\w*|trending|popular|widget|topbar|header|legal|discussion|login|search|skip)")
STRONG_PRIOR, WEAK_PRIOR, OUTSIDE_PRIOR = 0.02, 0.1, 0.15
_NEGATED = frozenset("has no not with without hide show".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag closes an open one of these, up to a container.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_WORDS = re.compile(r"[A-Za-z0-9]+")
#: Width of the smoothing window, characters and marks a node at which a ratio is one half, threshold as a
#: share of the best path, and the share of link text from which a block outside an article is a menu.
SIGMA, HALF_CHARS, HALF_MARKS, THRESHOLD, LINKED = 1.5, 80.0, 1.0, 0.25, 0.6
#: Characters and share of link text at which a named part of an article is prose.
PROSE_CHARS, PROSE_LINKED = 120, 0.3


class _Element:
    __slots__ = ("tag", "parent", "block", "never", "links", "path", "named", "article", "chars", "linked", "holds", "prior", "count", "inside", "bare")

    def __init__(self, tag: str, parent: _Element | None, never: bool, path: int, named: list[str], article: bool):
        self.tag, self.parent, self.never, self.path, self.named = tag, parent, never, path, named
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.links = (parent.links if parent is not None else 0) + (tag == "a")
        self.article = article or (parent is not None and parent.article)
        self.holds = article
        self.chars = self.linked = self.count = 0


class _Node:
    """A run of text in one block: its innermost block element, text, and characters in links."""

    __slots__ = ("element", "parts", "linked", "text")

    def __init__(self, element: _Element):
        self.element, self.parts, self.linked, self.text = element, [], 0, ""


def _name_words(attrs: dict[str, str]) -> list[str]:
    """Words of class, id and role in lower case; none that follows a negation (no-sidebar, has-sidebar)."""
    out = []
    for name in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
        words = [w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
        if not _NEGATED.intersection(words):
            out += words
    return out


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paths: dict[tuple[int, str], int] = {}
        self.elements = [_Element("", None, False, 0, [], False)]
        self.stack = [self.elements[0]]
        self.opened: Counter[str] = Counter()
        self.nodes: list[_Node] = []
        self.node: _Node | None = None

    def _ends_block(self, tag: str) -> bool:
        return tag not in INLINE and tag not in WITHIN and not self.stack[-1].never

    def handle_starttag(self, tag, attrs):
        if self._ends_block(tag):
            self.node = None
        if not self.stack[-1].never:
            if tag in _CLOSES_P:
                self._close({"p"}, {"button", "table", "td", "th", "body"})
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
        if tag in VOID:
            if tag == "br" and self.node is not None:
                self.node.parts.append(" ")
            return
        top = self.stack[-1]
        a = {k: v or "" for k, v in attrs}
        words = sorted(f".{w}" for k in ("class", "id") for w in a.get(k, "").split())
        path = self.paths.setdefault((top.path, tag + "".join(words)), len(self.paths) + 1)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) is not None
        named = _name_words(a)
        article = tag == "main" or (tag == "article" and not any(STRONG.fullmatch(w) for w in named))
        self.stack.append(_Element(tag, top, top.never or tag in NEVER or hidden, path, named, article))
        self.elements.append(self.stack[-1])
        self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe", "object") and self.stack[-1].tag == tag:
            self._cut(len(self.stack) - 1)

    def _cut(self, at):
        for e in self.stack[at:]:
            self.opened[e.tag] -= 1
        del self.stack[at:]

    def _close(self, tags, stop):
        if not any(self.opened[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._cut(i)
                return
            if self.stack[i].tag in stop:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br" and self.node is not None:
                self.node.parts.append(" ")
            return
        if self._ends_block(tag):
            self.node = None
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return

    def handle_data(self, data):
        top = self.stack[-1]
        if top.never:
            return
        if self.node is None:
            if not data.strip():
                return
            self.node = _Node(top.block)
            self.nodes.append(self.node)
        self.node.parts.append(data)
        if top.links:
            self.node.linked += len("".join(data.split()))


def _sum_up(elements: list[_Element], nodes: list[_Node]) -> None:
    """Characters, link characters and articles of every subtree, and the prior of what stands in it.

    Children follow their parents in the list of elements.
    """
    for n in nodes:
        n.element.chars += len(n.text)
        n.element.linked += min(n.linked, len(n.text))
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
        e.parent.linked += e.linked
        e.parent.holds |= e.holds and e.chars > 0
    root = elements[0]
    for e in elements:
        own = 1.0
        if e.tag in FURNITURE and not (e.tag in ("form", "fieldset") and (e.holds or 2 * e.chars > root.chars)):
            own = FURNITURE_PRIOR
        elif e.tag not in ("html", "body", "main", *HEADINGS) and not (e.holds or (not root.holds and 2 * e.chars > root.chars)):
            prose = e.article and e.chars >= PROSE_CHARS and e.linked <= PROSE_LINKED * e.chars
            if any(STRONG.fullmatch(w) and not (prose and OWN.fullmatch(w)) for w in e.named):
                own = STRONG_PRIOR
            elif not e.article and (e.tag == "header" or any(WEAK.fullmatch(w) for w in e.named)):
                own = WEAK_PRIOR
        e.prior = min(own, e.parent.prior) if e.parent is not None else own


def _smooth(values: list[float]) -> list[float]:
    reach = range(-3, 4)
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in reach]
    out = []
    for i in range(len(values)):
        own = [(kernel[k + 3], values[i + k]) for k in reach if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in own) / sum(w for w, _ in own))
    return out


def _scores(nodes: list[_Node], root: _Element) -> list[float]:
    """The fused tag-path ratio at each node, the same for all nodes of a path."""
    total: dict[int, list[float]] = {}
    for n in nodes:
        t = total.setdefault(n.element.path, [0.0, 0.0, 0.0, 0.0, 0.0])
        for i, x in enumerate((len(n.text), len(_PUNCTUATION.findall(n.text)), 1, n.linked)):
            t[i] += x
    paths = [total[n.element.path] for n in nodes]
    chars, marks = _smooth([t[0] / t[2] for t in paths]), _smooth([t[1] / t[2] for t in paths])
    for n, t, c, m in zip(nodes, paths, chars, marks, strict=True):
        outside = OUTSIDE_PRIOR if root.holds and not n.element.article else 1.0
        t[4] += c / (c + HALF_CHARS) * (0.5 + 0.5 * m / (m + HALF_MARKS)) * n.element.prior * outside / t[2]
    return [t[4] * (1 - min(1.0, t[3] / max(1.0, t[0]))) ** 2 for t in paths]


def extract(html: str | None) -> str:
    """The main text of a page; empty for a null or empty page and one without text."""
    if not html:
        return ""
    page = _Page()
    # A tag that the end of the page cuts off is no text.
    page.feed(re.sub(r"<(?:[/!?a-zA-Z][^<>]*)?\Z", "", html))
    page.close()
    for n in page.nodes:
        n.text = " ".join("".join(n.parts).split())
    nodes = [n for n in page.nodes if n.text]
    if not nodes:
        return ""
    elements, root = page.elements, page.elements[0]
    _sum_up(elements, nodes)
    score = _scores(nodes, root)
    least = THRESHOLD * max(score)
    content = [s >= least for s in score]
    # The deepest element that holds all content nodes.
    for n, c in zip(nodes, content, strict=True):
        n.element.count += c
    for e in reversed(elements[1:]):
        e.parent.count += e.count
    region = root
    for e in elements:
        if e.parent is region and e.count == root.count:
            region = e
    # For every element, whether it is in the region, and the outermost one above it that holds no content.
    for e in elements:
        e.inside = e is region or (e.parent is not None and e.parent.inside)
        e.bare = None if e.count else (e.parent.bare if e.parent is not None else None) or e
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    whole_page = region.tag in ("", "html", "body")
    out = []
    for i, (n, c) in enumerate(zip(nodes, content, strict=True)):
        e = n.element
        if not c:
            bare = e.bare or e
            linked = bare.linked > LINKED * bare.chars and not e.article
            if not e.inside or e.prior < 1 or linked or (whole_page and not first < i < last and e.tag not in HEADINGS):
                continue
        out.append(n.text)
    return "\n\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages: text is empty where there is none, n_chars its code points.

    Null html gives an empty text, ids and urls are passed through, repeated rows repeat, an empty
    table gives no rows and other columns are ignored.
    """
    C.prepare(pages.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9_html_extraction over the whole pages table."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
