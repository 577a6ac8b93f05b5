"""Main text of web pages by composite text density.

Every DOM node gets a link-adjusted number of characters per tag,

    C / T * log_b(C * T / (LC * LT)),   b = ln(C * LC / (C - LC) + C * LC_body / C_body + e), 2 at least,

with C its characters, T its tags, LC and LT those in links (0 counts as 1). Text that stands directly in a node counts as a child
of its own. A node's density sum adds up the densities of its children; the subtree with the largest sum is the article's
centre, and is taken whole, whatever its classes and links. The smallest density on its path to the body is the threshold. Beside
the path, a subtree is taken if its density reaches NEAR of the threshold; below that, the markup settles close cases: headings,
prose in a wrapper of the centre, and what stands in the same <article> are taken unless most of their characters are links.

Left out before anything is counted: elements that are no article text by their tag, and hidden ones. Roles, forms, and classes and
ids that name menus, headers, footers, sidebars, notices, adverts, forms or reader comments are claims, which links, place and
density have to bear out. The article is first looked for without the claimed elements. A claim is plain if all words of the name
speak for it (`post-comments-list`, not `market-share`) and the element is no paragraph, table or other prose by itself. What is
claimed plainly goes if a quarter of its characters are links, if it stands outside the article's centre, or if its density is below
the centre's; a vague claim only counts where half the characters are links. No claim is believed of an element that holds the page's
<h1> or <main>, and none at all if the claimed elements hold four fifths of the text of a page without <article>, <main> or <h1>. Time and memory grow with the length of the
page, at any depth of nesting.

Defined results: null, empty and wordless pages give the empty string; unclosed tags, comments and quotes run to the end of the
page; end tags without a start are ignored; bytes that are not UTF-8 count as the replacement character; very long pages are read whole, one at a time; repeated rows are extracted row by row;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
#: Elements that never hold article text.
OUTSIDE = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input label iframe object"
    " embed svg canvas audio video noembed noframes dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar topbar"
    " sidebar aside rail widget widgets related recommended share sharing social buttons"
    " header masthead footer colophon copyright"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall login signup"
    " form search searchform comment comments commentlist disqus respond".split()
)
#: Marks that an article's own parts may have as well: never plain.
VAGUE = frozenset("discussion reply replies form notice notices alert related".split())
#: Words of a place or a shape, which say nothing.
SHAPES = frozenset("list box section container wrapper wrap block area inner outer left right top bottom item items unit slot panel row col".split())
#: Words of the page and its readers, which say nothing either; of a header, they make it part of the article.
OWN = frozenset("article entry post story content page title".split())
SITE = frozenset("site web blog my js id view thread user reader readers visitor top bottom main global primary secondary mobile desktop google dfp sticky fixed full text image video link links area zone bar group wide unit".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = frozenset("p blockquote pre ul ol dl table figure".split())
PARAGRAPHS = frozenset("p blockquote pre li dd dt td th tr tbody table figure figcaption h1 h2 h3 h4 h5 h6 span em strong b i".split())
NEVER_MARKED = frozenset("html body main article".split())
#: The share of the threshold from which a subtree beside the centre's path is article text, whatever its markup.
NEAR = 0.25

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A start tag closes these open elements, up to the nearest element of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_P_SCOPE = frozenset("table td th button object caption html body li article section div blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "mark", "out", "link", "holds", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: str):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.parts: list = []  # child nodes and strings
        self.link = tag == "a" or (parent is not None and parent.link)
        self.out = self.holds = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def claim(name: str) -> str:
    """What a class or id says: "plain" if all of its words mark what is no article text, "vague" if the last one that says anything
    does, else "". """
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    says = [w for w in words if w not in SHAPES]
    if not says or says[-1] not in MARKS | VAGUE or (says[-1] == "header" and OWN.intersection(says)):
        return ""
    return "plain" if all(w in MARKS or w in OWN or w in SITE for w in says) and says[-1] not in VAGUE else "vague"


def _mark(tag: str, attrs: str, parent: Node) -> str:
    """What an element's own tag and attributes say against it: "sure", "plain", "vague" or nothing."""
    if tag == "form":
        return "plain"
    if tag == "footer" and parent.tag in PARAGRAPHS:
        return ""  # the author of a quotation
    if tag in OUTSIDE:
        return "sure"
    if tag == "header":
        within = parent
        while within is not None and within.tag not in ("article", "main"):
            within = within.parent
        if within is None:
            return "sure"
    if not attrs or tag in NEVER_MARKED:
        return ""
    found = {m[0].lower(): next((v for v in m[1:] if v), "") for m in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "sure"
    if found.get("role", "").lower() in ROLES:
        return "plain"
    claims = {claim(name) for name in (found.get("id", ""), *found.get("class", "").split())}
    if "plain" in claims and tag not in PARAGRAPHS:
        return "plain"
    return "vague" if claims & {"plain", "vague"} else ""


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, parents before children."""
    root = at = Node("#root", None, "")
    nodes, pos, end = [root], 0, len(page)
    open_tags: Counter = Counter()

    def leave(node: Node) -> None:
        """Closes all open elements up to and with node."""
        nonlocal at
        while at is not node:
            open_tags[at.tag] -= 1
            at = at.parent
        open_tags[at.tag] -= 1
        at = at.parent

    def close(names: set | frozenset, scope: set | frozenset) -> None:
        if not any(open_tags[name] > 0 for name in names):
            return
        node = at
        while node.parent is not None and node.tag not in scope:
            if node.tag in names:
                leave(node)
                return
            node = node.parent

    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            at.parts.append(entities.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.parts.append(entities.unescape(page[pos : m.start()]))
        pos = m.end()
        if name := m["end"]:
            name = name.lower()
            if open_tags[name] > 0:
                node = at
                while node.tag != name:
                    node = node.parent
                leave(node)
        elif name := m["start"] or m["odd"]:
            name, attrs = name.lower(), m["attrs"] or m["rest"] or ""
            if name in BLOCKS and name not in ("html", "body"):
                close({"p"}, _P_SCOPE)
            if name in _CLOSES:
                close(*_CLOSES[name])
            node = Node(name, at, _mark(name, attrs, at))
            at.parts.append(node)
            nodes.append(node)
            if name in RAW:
                stop = re.compile(rf"</{name}\s*/?>", re.I).search(page, pos)
                if name == "textarea":
                    node.parts.append(page[pos : stop.start() if stop else end])
                pos = stop.end() if stop else end
            elif name not in VOID and not attrs.endswith("/"):
                at = node
                open_tags[name] += 1
    return root, nodes


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Link-adjusted characters per tag. ratio: the share of link characters of the whole body."""
    if not chars:
        return 0.0
    t = max(1, tags)
    adjusted = math.log(max(1.0, chars * t / (max(1, link_chars) * max(1, link_tags))))
    base = math.log(chars * link_chars / max(1, chars - link_chars) + ratio * chars + math.e)
    return chars / t * adjusted / math.log(max(2.0, base))


def _count(nodes: list[Node]) -> None:
    """Characters, tags, densities and density sums of all nodes that are not out."""
    own: list[int] = [0] * len(nodes)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.out:
            continue
        own[k] = sum(len("".join(s.split())) for s in node.parts if isinstance(s, str))
        node.chars += own[k]
        if node.link:
            node.link_chars += own[k]
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    ratio = body.link_chars / max(1, body.chars)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.out:
            continue
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        node.total += composite_density(own[k], 1, own[k] * node.link, int(node.link), ratio)
        if node.parent is not None:
            node.parent.total += node.density


def weigh(nodes: list[Node]) -> None:
    """What is left out, then counts, density and density sum of every other node."""
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.holds |= node.holds or node.tag in ("h1", "main")

    def leave_out(gone) -> None:
        for node in nodes:
            node.out = (node.parent is not None and node.parent.out) or node.mark == "sure" or gone(node)

    claimed = [n for n in nodes if n.mark in ("plain", "vague") and not n.holds]
    leave_out(lambda n: False)
    _count(nodes)
    if not claimed:
        return
    whole, seen = nodes[0].chars, {id(n): (n.chars, n.link_chars, n.density) for n in claimed if not n.out}
    claims = set(seen)
    leave_out(lambda n: id(n) in claims)
    _count(nodes)
    centre, rest = centre_of(nodes), nodes[0].chars
    believed = 4 * rest > whole - rest or any(n.chars and not n.out and n.tag in ("article", "main", "h1") for n in nodes)
    inside: set[int] = set()
    if centre is not None:
        for node in nodes:  # parents come first
            if node is centre or (node.parent is not None and id(node.parent) in inside):
                inside.add(id(node))
    gone = set()
    for node in claimed:
        chars, links, density = seen.get(id(node), (0, 0, 0.0))
        if 2 * links > chars:
            gone.add(id(node))
        elif node.mark == "plain" and centre is not None and believed and (4 * links >= chars or id(node) not in inside or density < centre.density):
            gone.add(id(node))
    leave_out(lambda n: id(n) in gone)
    _count(nodes)


def _blocks(top: Node, taken: set[int], texts: set[int]) -> list[str]:
    """The blocks of text below top in page order. taken: the subtrees to take; texts: nodes whose own strings are taken."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    work: list = [(top, False)]
    while work:
        item, inside = work.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                run.append(item)
        elif not item.out:
            inside = inside or id(item) in taken
            if item.tag in BLOCKS:
                flush()
                work.append((None, inside))
            elif item.tag in ("br", "td", "th"):
                run.append(" ")
            strings = inside or id(item) in texts
            work += [(part, strings if isinstance(part, str) else inside) for part in reversed(item.parts)]
    flush()
    return out


def centre_of(nodes: list[Node]) -> Node | None:
    """The node with the largest density sum; of equal ones the first in page order."""
    return max((n for n in nodes if not n.out and n.chars), key=lambda n: n.total, default=None)


def main_text(page: str | None) -> str:
    """Blocks of the article, one a line."""
    if not page:
        return ""
    _, nodes = parse(page)
    weigh(nodes)
    centre = centre_of(nodes)
    if centre is None:
        return ""
    path = [centre]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    near = NEAR * min(n.density for n in path)
    own = next((i for i, n in enumerate(path) if n.tag == "article"), 0)  # the centre's article, if it is in one
    taken, texts, on_path = {id(centre)}, set(), set(map(id, path))
    for i, node in enumerate(path[1:], 1):
        for child in node.parts:
            if isinstance(child, str):
                n = len("".join(child.split()))
                if i <= own or composite_density(n, 1, n * node.link, int(node.link), 0.0) >= near:
                    texts.add(id(node))
            elif id(child) not in on_path and not child.out:
                close_case = child.tag in HEADINGS or i <= own or (child.tag in PROSE and node is not path[-1])
                if child.density >= near or (close_case and 2 * child.link_chars <= child.chars):
                    taken.add(id(child))
    return "\n".join(_blocks(path[-1], taken, texts))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id_col, url_col, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page.decode("utf-8", "replace") if page is not None else None) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
