"""HTML extraction by composite text density.

A page becomes its tree of elements, inline ones too.  Elements that are no article by their tag, role, visibility or a whole
name in their class or id (menus, page headers and footers, sidebars, notices, adverts, forms, reader comments) are cut
off.  Every node that is left gets the characters, tags, link characters and link tags below it, and from them its composite
density: characters a tag, adjusted for links; the text that stands in a node itself counts as a node of one tag.  The sum
of the densities of a node's children decides: the container with the largest sum holds the text.  The lowest density on
the way from it up to the body is the threshold.

What is taken: the container of the largest sum, grown to the <article> or <main> around it unless that adds mostly links;
with it, every other node that reaches the threshold (an article that is split over several containers) where there is
no <article> or <main>, and else those of the same tag and class; headings right before what is taken, and what stands
between two taken nodes of one parent and is not mostly links.  Outside of <article> and <main>, blocks of mostly links below
the threshold are left out of what is taken, but not paragraphs and items that are links among others that are none.  All other text of it is returned, block by block.

A name cuts an element off if a whole class token or id says so: one of a list of words ("sidebar"), or two of them that go
together ("site-footer", "cookie-notice"; not "has-sidebar", "social-history" or "share-holder").  An element (a form, too)
that the largest sum lies in stays if little text is outside it; one named after comments only if it holds a page heading
or <main>.  A header within the article stays if it holds its h1.  Names that parts of an article have too ("header", "form",
"search", "login") cut nothing off within it that is no menu and is a block of text, has a heading, or is dense.

Defined cases: a null or empty page, and one without text, give an empty string; unclosed and crossing tags are
repaired as browsers do for blocks; a cut-off tag or comment at the end ends with the page; of nodes with equal
sums the outermost, then the first, counts; repeated rows give one result each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Attributes as browsers read them: a quote opens a value only right behind the equals sign; anywhere else it is a character.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|object|title)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s/>="']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second within the nearest container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text rather than other blocks, and the parts of lists and tables.
TEXTUAL = HEADINGS | frozenset("p li pre dd dt blockquote ul ol dl tr td th thead tbody tfoot table caption figcaption legend summary address hr".split())
NOT_TEXT = frozenset("nav header footer aside dialog menu search head fieldset button label option".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements around a whole page or article, which no name or role cuts off.
WRAPPERS = frozenset("html body main article".split())
# Names of elements that are no article.
COMMENTS = frozenset("comment comments commentlist respond disqus discussion replies reply".split())
NAMES = COMMENTS | frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer footnav cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended pagination pager skip toolbar login search form".split())
#: Second words after one of NAMES ("cookie-banner", "related-posts"), and first words before one of those behind them ("site-footer").
HOLDERS = frozenset("area bar block box buttons container content form icons inner items left links list modal notice overlay popup posts articles stories right section slot unit widget wrapper wrap".split())
SCOPES = frozenset("site page global top bottom main primary secondary mobile blog post entry article reader user left right".split())
SITE = frozenset("site page global top main primary secondary mobile blog".split())
#: Names that parts of an article have as well: within one they cut off only what looks the part.
AMBIGUOUS = frozenset("header form search login".split())
INNER = NAMES - frozenset("header form search notice notices login widget widgets".split())


@lru_cache(maxsize=1 << 16)
def named(value: str) -> frozenset[str]:
    """The words of NAMES by which a class or id says that an element is no article."""
    found: set[str] = set()
    for token in value.lower().split():
        if token in NAMES:
            found.add(token)
            continue
        first, _, second = token.replace("_", "-").partition("-")
        if first in NAMES and (second in NAMES or second in HOLDERS):
            found |= {first} | ({second} & NAMES)
        elif first in SCOPES and second in INNER or first in SITE and second == "header":
            found.add(second)
    return frozenset(found)


class Node:
    __slots__ = ("tag", "key", "parent", "parts", "inline", "link", "cut", "names", "chars", "tags", "links", "linked", "own", "voids", "density", "total")

    def __init__(self, tag: str, parent: Node | None, inline: bool = False, link: bool = False):
        self.tag, self.parent, self.inline = tag, parent, inline
        self.link = link or parent is not None and parent.link
        self.key, self.cut, self.names = "", tag in NOT_TEXT, frozenset()
        self.parts: list[Node | str] = []
        self.own = self.voids = self.chars = self.tags = self.links = self.linked = 0
        self.density = self.total = 0.0
        if parent is not None:
            parent.parts.append(self)

    def read(self, attributes: str) -> None:
        """What class, id, role and visibility say."""
        if self.tag in WRAPPERS or not attributes.strip():
            if self.tag in WRAPPERS:
                self.key = " ".join((a or b or c).lower() for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))
            return
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                self.key = f"{self.key} {value.lower()}".strip()
                self.names |= named(value)
            elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                self.cut = True
            elif name == "href" and self.tag == "a":
                self.link = True


def parse(html: str) -> Node:
    """The tree of elements."""
    root = Node("body", None)
    node, head = root, False
    for m in TOKEN.finditer(html):
        text = m[5]
        if text is not None:
            if not head or text.strip():
                node.parts.append(text)
                node.own += len(text.strip())
            continue
        if m[3] is None:
            continue
        tag, end = m[3].lower(), bool(m[2])
        if tag in ("html", "body", "head", "meta", "link", "base"):
            head = tag == "head" and not end
        elif tag in VOID:
            node.voids += 1
            if tag == "br":
                node.parts.append(" ")
        elif tag == "hr":
            Node("hr", _block(node)).cut = True
        elif end:
            node = _close(node, tag)
        elif tag not in BLOCKS:
            if tag == "a":  # one link does not hold another
                node = _close(node, "a", within=True)
            new = Node(tag, node, inline=True)
            new.read(m[4])
            if not CLOSED.search(m[4]):
                node = new
        else:
            up = _block(node)
            if up.tag == "p" or tag in HEADINGS and up.tag in HEADINGS:
                node = up.parent
            if tag in ENDS:
                close, stop = ENDS[tag]
                up = node
                while up is not root and up.tag not in stop:
                    if up.tag in close:
                        node = up.parent
                    up = up.parent
            node = Node(tag, node)
            node.read(m[4])
            if tag == "form":
                node.names |= {"form"}
    return root


def _block(node: Node) -> Node:
    while node.inline:
        node = node.parent
    return node


def _close(node: Node, tag: str, within: bool = False) -> Node:
    """The parent of the nearest open element of that tag; inline tags don't end the block around them (``within``)."""
    inline, up = within or tag not in BLOCKS, node
    while up is not None and up.tag != tag:
        if inline and not up.inline:
            return node
        up = up.parent
    return up.parent if up is not None and up.parent is not None else node


def _below(node: Node) -> Iterator[Node]:
    """All nodes below that are not cut, in page order."""
    stack = [x for x in reversed(node.parts) if isinstance(x, Node)]
    while stack:
        x = stack.pop()
        if not x.cut:
            yield x
            stack += [y for y in reversed(x.parts) if isinstance(y, Node)]


def _way(node: Node) -> list[Node]:
    """The node and all above it, up to the body."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def density(c: int, t: int, lc: int, lt: int, linked: int, body: int) -> float:
    """Composite density of c characters, t tags, lc link characters, lt link tags; of the body: linked of ``body``."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + linked / max(body, 1) * c + math.e)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0) + 1) / math.log(base + 1)


def measure(root: Node) -> list[Node]:
    """Densities and sums of all nodes that are left, in page order; named elements are cut on the way."""
    order = _measure(root)
    return _measure(root) if _cut_by_name(order) else order


def _measure(root: Node) -> list[Node]:
    for n in _below(root):
        for x in n.parts:  # the heading of the article itself
            if isinstance(x, Node) and x.cut and x.tag == "header" and _in_article(x) and any(y.tag == "h1" for y in _below(x)):
                x.cut = False
    order = [root, *_below(root)]
    for n in order:
        n.chars, n.tags, n.links, n.linked = n.own, n.voids, 0, n.own if n.link else 0
    for n in reversed(order):
        if n.parent is not None:
            up = n.parent
            up.chars += n.chars
            up.tags += n.tags + 1
            up.links += n.links + (n.tag == "a" and n.link)
            up.linked += n.linked
    of_body = (root.linked, root.chars)
    for n in order:
        n.density = density(n.chars, n.tags, n.linked, n.links, *of_body)
        n.total = density(n.own, n.voids + 1, n.own if n.link else 0, int(n.link), *of_body)
    for n in order[1:]:
        n.parent.total += n.density
    return order


def _in_article(node: Node) -> bool:
    return any(n.tag in ("article", "main") for n in _way(node.parent))


def _best(order: list[Node]) -> Node:
    """The container of the largest sum; the first of equal sums is the outermost."""
    return max((n for n in order if not n.inline and n.tag not in TEXTUAL), key=lambda n: n.total)


def _cut_by_name(order: list[Node]) -> bool:
    """Cut what its name says is no article; ``order`` has been measured with all of it.  Whether anything was cut."""
    found = [n for n in order if n.names]
    if not found:
        return False
    way = {id(n) for n in _way(_best(order))}
    free, aside = order[0].chars - order[0].linked, set()  # text that no named element off the way holds
    for n in order:
        if n.parent is not None and id(n.parent) in aside:
            aside.add(id(n))
        elif n.names and id(n) not in way:
            aside.add(id(n))
            free -= n.chars - n.linked
    least = min(n.density for n in _way(_best(order)))
    for n in found:
        if id(n) not in way:
            n.cut = not (n.names <= AMBIGUOUS and n.tag != "form" and (_in_article(n) or id(n.parent) in way) and _reads(n, least))
        elif COMMENTS & n.names:
            n.cut = not any(x.tag in ("h1", "main") for x in _below(n))
        else:
            mine = n.chars - n.linked
            n.cut = (free - mine) * 4 >= mine
    return any(n.cut for n in found)


def _reads(node: Node, least: float) -> bool:
    """Whether an element within an article reads as text: it is no menu, and it is a block of text, has a heading, or is dense."""
    if node.linked * 2 > node.chars or not node.chars:
        return False
    return node.tag in TEXTUAL or node.density >= least or any(x.tag in HEADINGS for x in _below(node))


def select(root: Node) -> list[Node]:
    order = measure(root)
    best = _best(order)
    if not best.chars:
        return []
    way = _way(best)
    least = min(n.density for n in way)
    article = next((n for n in way if n.tag in ("article", "main")), None)
    if article is not None and (article.linked - best.linked) * 2 <= article.chars - best.chars:
        best = article
    taken = {id(best)}
    inside = {id(n) for n in _below(best)} | {id(n) for n in _way(best)}
    for n in order:
        if id(n.parent) in taken and id(n) not in inside:
            inside.add(id(n))
            taken.add(id(n))  # below a taken node; told apart from it at the end
        elif id(n) not in inside and not n.inline and n.chars and n.density >= least and (article is None or (n.tag, n.key) == (best.tag, best.key)):
            taken.add(id(n))
    tops = [n for n in order if id(n) in taken and id(n.parent) not in taken]
    more = {id(n) for n in tops}
    for up in {id(n.parent): n.parent for n in tops if n.parent is not None}.values():
        more |= _between(up, more)
    for n in tops:
        more |= _headings(n, more)
        if article is None:
            for x in _below(n):  # menus that no tag or name tells apart
                x.cut = not x.inline and x.density < least and x.linked * 2 > x.chars and not _item(x)
    return [n for n in order if id(n) in more]


def _item(node: Node) -> bool:
    """A paragraph or item that is a link among others that are none."""
    up = node.parent
    return node.tag in TEXTUAL and node.tag not in ("ul", "ol", "dl", "table") and up is not None and up.linked * 2 <= up.chars


def _between(up: Node, taken: set[int]) -> set[int]:
    """Children between two taken ones that hold text which is not mostly links."""
    children = [x for x in up.parts if isinstance(x, Node) and not x.cut]
    at = [i for i, x in enumerate(children) if id(x) in taken]
    return {id(x) for x in children[at[0] : at[-1]] if x.chars and x.linked * 2 <= x.chars and not x.inline} if at else set()


def _headings(node: Node, taken: set[int]) -> set[int]:
    """Headings (alone in their element) that stand right before a taken node, or before the element it begins."""
    out: set[int] = set()
    while node.parent is not None:
        parts = node.parent.parts
        for i in range(parts.index(node) - 1, -1, -1):
            x = parts[i]
            if isinstance(x, str) and x.strip() or isinstance(x, Node) and not x.cut and x.chars and not _is_heading(x) and x.linked < x.chars:
                return out
            if isinstance(x, Node) and not x.cut and _is_heading(x):
                if id(x) in taken:
                    return out
                out.add(id(x))
        node = node.parent
    return out


def _is_heading(node: Node) -> bool:
    below = sum(n.chars for n in _below(node) if n.tag in HEADINGS)
    return node.linked * 2 <= node.chars and (node.tag in HEADINGS or node.chars > 0 and below == node.chars)


def blocks(node: Node) -> Iterator[str]:
    """Text blocks below a node in page order; white space within a block is one space, and a table's row is one block."""
    run: list[str] = []
    cells, stack = 0, [(iter(node.parts), node)]

    def block() -> list[str]:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        return [text] if text else []

    while stack:
        parts, of = stack[-1]
        x = next(parts, None)
        if isinstance(x, str):
            run.append(x)
            continue
        edge = of if x is None else x
        if x is None:
            stack.pop()
            cells -= of.tag in ("td", "th")
        if not edge.inline and x is not None or x is None and not of.inline:
            if cells or edge.tag in ("td", "th"):
                run.append(" ")
            else:
                yield from block()
        if x is not None and not x.cut:
            cells += x.tag in ("td", "th")
            stack.append((iter(x.parts), x))
    yield from block()


def main_text(html: str) -> str:
    return "\n\n".join(text for node in select(parse(html)) for text in blocks(node))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (its code points) of each whole page; nothing is shuffled."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                at = batch.schema.get_field_index("__html")
                texts = [main_text(v.as_py() or "") for v in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    common.tidy(common.session_of(pages))
    return pages.select(*(F.col(c) for c in keep), F.col(html).alias("__html")).mapInArrow(common.released(run), schema)
