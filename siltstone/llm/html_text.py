"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of block tags from the root. Each path gets its text length per node and
its punctuation marks per node; both are smoothed over neighbouring paths in page order and fused with the share of
the page's text that the path holds and with the share of it outside of links. Paths over a share of the best one are
content. The content region is the innermost element that holds most of their text. The main text is all that stands in
it, if the page declares it to be an article, else from the headings before its first content node to its last one and
the lists, tables and quotes right behind that.

What HTML itself declares to be no text or no article goes first: scripts, forms, navigation, footers, hidden
elements. Article elements and class or id names weigh on the ratio of a box's path. A box in the region whose whole
name is one of BOX_NAMES goes unless its path is content; where only the beginning is, prose stays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.store import fresh
from siltstone.llm.words import batches_of

#: Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr",)}
RAW = "script|style|iframe|textarea|title|noembed|noframes|xmp"
#: Elements whose text is for browsers that can't show them; one that is never closed holds nothing.
INSTEAD = frozenset("noscript template svg canvas object audio video annotation".split())
#: Elements and landmark roles that stand beside the article.
ASIDE_TAGS = frozenset("head nav header footer aside form button select dialog menu fieldset datalist".split()) | INSTEAD
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
#: Whole names in a class or id, or their beginnings up to a hyphen or underscore, that make a box less likely content.
BOX_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation breadcrumb breadcrumbs sidebar masthead cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe subscription signup login related recommended comment comments disqus replies pagination pager toolbar widget footer menu".split()
)
ROOT_TAGS, ROOT_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text, not boxes of it: no region begins in them and their names say nothing.
LISTS = frozenset("ul ol dl table thead tbody tfoot figure".split())
TEXTS = HEADINGS | frozenset("p li dt dd td th tr pre blockquote figcaption caption address summary".split())

TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<({RAW})(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKS = re.compile(r"[.,;:!?…¿¡。、，！？]")
#: A path is content from this share of the best path's fused ratio on; weights of the paths before, at and after.
SHARE, SMOOTH = 0.1, (0.1, 0.8, 0.1)
#: What an article element and a box's name weigh on a ratio, and the share of the content that a region holds at least.
IN_ARTICLE, IN_BOX, REGION = 8.0, 0.05, 0.6
#: The same of a name that only begins like a box's, and the characters from which a block in such a box is prose.
LIKE_BOX, PROSE = 0.2, 80
#: Names that say what a box is even as a beginning.
ALWAYS = BOX_NAMES - frozenset("related recommended notice notices menu navigation widget toolbar footer".split())


def standing(tag: str, attributes: str) -> tuple[bool, float]:
    """Whether an element stands beside the article whatever it holds, and its weight on the ratio of what it holds."""
    weight = IN_ARTICLE if tag in ROOT_TAGS else 1.0
    if not attributes.strip():
        return tag in ASIDE_TAGS, weight
    found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if role in ROOT_ROLES:
        weight = IN_ARTICLE
    if tag not in TEXTS and tag not in INLINE and tag not in ("html", "body"):
        names = (found.get("class", "") + " " + found.get("id", "")).lower().split()
        starts = [re.split("[-_]", n)[0] for n in names]
        if any(n in BOX_NAMES for n in names) or any(n in ALWAYS for n in starts):
            weight *= IN_BOX
        elif any(n in BOX_NAMES for n in starts):
            weight *= LIKE_BOX
    return bool(tag in ASIDE_TAGS or role in ASIDE_ROLES or hidden), weight


@dataclass
class Node:
    """A text node: the path of its block, the block's number, its element, whether it is in a link, and its weight."""

    path: str
    block: int
    element: int
    link: bool
    weight: float
    text: str


@dataclass
class Open:
    """An open element: its tag, block path and number, whether it stands beside the article or in a link, its weight."""

    tag: str
    path: str
    element: int
    aside: bool
    link: bool
    weight: float


class Page:
    """Text nodes of a page in order, but for those beside the article, and of its block elements the tags, parents and
    whether they are declared to be an article."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.tags, self.parents, self.declared = [""], [-1], [False]
        stack = [Open("", "", 0, False, False, 1.0)]
        block = at = 0
        closed: dict[str, int] = {}  # the last end tag of each element
        for token in TOKEN.finditer(source):
            if token.start() > at:
                self._text(source[at : token.start()], stack[-1], block)
            at = token.end()
            tag = (token[3] or token[6] or "").lower()
            if not tag:
                if token[1]:
                    block += token[1].lower() not in INLINE
                continue
            if tag == "br":
                self._text(" ", stack[-1], block)
                continue
            block += tag not in INLINE and not stack[-1].aside
            if token[2] or token[5]:
                if any(tag == x.tag for x in reversed(stack)):
                    while stack.pop().tag != tag:
                        pass
                continue
            if tag in VOID:
                continue
            if tag in INSTEAD:
                if tag not in closed:
                    closed[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s/>]", source, re.I)), default=-1)
                if closed[tag] < at or tag == "svg" and (token[4] or token[7] or "").rstrip().endswith("/"):
                    continue
            if tag in CLOSES_P:
                self._close(stack, ("p",), ("table", "td", "button"))
            if tag in SIBLINGS:
                self._close(stack, SIBLINGS[tag], ("ul", "ol", "dl", "table", "menu", "select"))
            attributes = token[4] or token[7] or ""
            aside, weight = standing(tag, attributes)
            top = stack[-1]
            if tag in INLINE:
                stack.append(Open(tag, top.path, top.element, top.aside or aside, top.link or tag == "a", top.weight))
                continue
            self.tags.append(tag)
            self.parents.append(top.element)
            self.declared.append(weight == IN_ARTICLE and tag != "main")
            stack.append(Open(tag, f"{top.path}/{tag}", len(self.tags) - 1, top.aside or aside, top.link, top.weight * weight))
            if attributes.rstrip().endswith("/") and tag not in CLOSES_P:
                stack.pop()
        if at < len(source):
            rest = source[at:]
            cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)
            self._text(rest[: cut.start()] if cut else rest, stack[-1], block)

    @staticmethod
    def _close(stack: list[Open], tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in walls or stack[i].tag in CLOSES_P and stack[i].tag not in tags:
                return

    def _text(self, text: str, top: Open, block: int) -> None:
        if not top.aside:
            self.nodes.append(Node(top.path, block, top.element, top.link, top.weight, html.unescape(text) if "&" in text else text))

    def holders(self, element: int) -> Iterator[int]:
        """The element and all that it stands in, from the innermost on."""
        while element >= 0:
            yield element
            element = self.parents[element]


def content_paths(nodes: list[Node]) -> set[tuple[str, float]]:
    """The paths, each with its weight, whose fused ratio reaches SHARE of the best one."""
    sums: dict[tuple[str, float], list[float]] = {}
    blocks: set[tuple[str, float, int]] = set()
    for node in nodes:
        n = len("".join(node.text.split()))
        if n:
            s = sums.setdefault((node.path, node.weight), [0, 0, 0, 0])
            if (node.path, node.weight, node.block) not in blocks:
                blocks.add((node.path, node.weight, node.block))
                s[0] += 1
            s[1] += n
            s[2] += len(MARKS.findall(node.text))
            s[3] += n if node.link else 0
    paths = list(sums)
    if not paths:
        return set()
    total = sum(s[1] for s in sums.values())

    def smooth(values: list[float]) -> list[float]:
        padded = [values[0], *values, values[-1]]
        return [sum(w * v for w, v in zip(SMOOTH, padded[i : i + 3])) for i in range(len(values))]

    length, marks = smooth([c / n for n, c, _, _ in sums.values()]), smooth([m / n for n, _, m, _ in sums.values()])
    fused = [t * (1 + p) * c / total * (1 - linked / c) * weight for t, p, (_, c, _, linked), (_, weight) in zip(length, marks, sums.values(), paths)]
    best = max(fused)
    return {path for path, f in zip(paths, fused) if f >= SHARE * best}


def region(page: Page, content: list[Node]) -> int:
    """The innermost element, not itself one of TEXTS, that holds the share REGION of the content's weighted text."""
    held: dict[int, float] = {}
    for node in content:
        n = len(node.text) * node.weight
        for element in page.holders(node.element):
            held[element] = held.get(element, 0) + n
    best = 0
    for element, n in held.items():
        if n >= REGION * held[0] and page.tags[element] not in TEXTS and element > best:  # inner ones have higher numbers
            best = element
    return best


def behind(page: Page, last: int) -> int:
    """The last text node of the lists, tables and quotes that stand right behind node ``last``, in the box that holds it.

    Headings between belong to what follows them. What is mostly links ends it, and so does any other box.
    """
    nodes = page.nodes
    box = next(e for e in page.holders(nodes[last].element) if page.tags[e] not in TEXTS | LISTS)
    level = nodes[last].weight
    while True:
        i, size, linked, listed = last + 1, 0, 0, False
        while i < len(nodes) and not nodes[i].text.strip():
            i += 1
        while i < len(nodes) and page.tags[nodes[i].element] in HEADINGS:
            i += 1
        start = None
        for i in range(i, len(nodes)):
            if not nodes[i].text.strip():
                continue
            chain = []
            for e in page.holders(nodes[i].element):
                if e == box:
                    break
                chain.append(e)
            else:
                break
            if not chain or any(page.tags[e] not in TEXTS | LISTS for e in chain) or start not in (None, chain[-1]):
                break
            if nodes[i].weight < level or page.tags[chain[-1]] not in LISTS | {"blockquote", "pre"}:
                break
            start, end, listed = chain[-1], i, True
            size += len(nodes[i].text.strip())
            linked += len(nodes[i].text.strip()) if nodes[i].link else 0
        if not listed or 2 * linked >= size:
            return last
        last = end


def main_text(source: str | None) -> str:
    """The main text of a page: blocks in page order, white space as single spaces; empty for a null or empty page."""
    if not source:
        return ""
    page = Page(source)
    paths = content_paths(page.nodes)
    content = [n for n in page.nodes if (n.path, n.weight) in paths]
    if not content:
        return ""
    inside = region(page, content)
    nodes = page.nodes
    within = [i for i, n in enumerate(nodes) if (n.path, n.weight) in paths and n.text.strip() and inside in page.holders(n.element)]
    if not within:
        return ""
    first, last = within[0], within[-1]
    if page.declared[inside]:
        within = [i for i, n in enumerate(nodes) if inside in page.holders(n.element)]
        first, last = within[0], within[-1]
    while last + 1 < len(nodes) and nodes[last + 1].block == nodes[last].block:
        last += 1
    while first and (nodes[first - 1].block == nodes[first].block or not nodes[first - 1].text.strip() or page.tags[nodes[first - 1].element] in HEADINGS):
        first -= 1
    last = behind(page, last)
    top = max(n.weight for n in content)
    sizes, linked = Counter(), Counter()
    for n in nodes[first : last + 1]:
        sizes[n.block] += len(n.text.strip())
        linked[n.block] += len(n.text.strip()) if n.link else 0
    blocks: list[str] = []
    block = None
    for n in nodes[first : last + 1]:
        if (n.path, n.weight) not in paths:
            if n.weight <= top * IN_BOX:  # a box in the region, named as one
                continue
            if n.weight <= top * LIKE_BOX and not (sizes[n.block] >= PROSE and 2 * linked[n.block] < sizes[n.block]):
                continue
        if n.block == block:
            blocks[-1] += n.text
        else:
            blocks.append(n.text)
            block = n.block
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def extract_text(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each whole page as one more column.

    A null or empty page, and one without text, gives an empty text. Every other column is kept; where pages has one
    of the new column's name, underscores are put behind the new one's. Malformed markup never fails: tags left open
    end with what encloses them.
    """
    text = fresh(pages.columns, text)
    at = pages.columns.index(source)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start, sources in batches_of(batch.column(at)):
                part = batch.slice(start, len(sources))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(s) for s in sources], pa.string())], names=[*batch.schema.names, text])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())]))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: the article's text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html_text": op7_html_text}
#: For pages whose article is one element without boxes inside, as the given ones are.
SQL = {
    "op7_html_text": r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '</?(p|h1|br)\b[^>]*>', ' ', 'g'), '</?b>', '', 'g') AS t FROM pages
), b AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS text FROM a
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM b
"""
}
