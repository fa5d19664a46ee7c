"""HTML extraction by wrapper induction: the text blocks of all pages of one host are aligned by their place in the tree.

A page is parsed into a tree whose leaves are blocks of text. A host's wrapper is counted over all its different pages, whatever
their number and length, and over all blocks outside article and main, menus and footers included. Pages are compared with those
of the same language (`lang` of html), once by slot (pages with a block at the same path of tags and classes) and once by layout
(pages with the same set of paths). A block that at least MIN_PAGES pages and SHARE of the pages of its slot or its layout hold with
the same path and text is template, one whose text varies is content. Pages first lose the blocks that are template for them. With
fewer than MIN_PAGES different pages a host has no wrapper. `induce` finds the constant blocks of a few pages by simple tree matching (the
largest order-preserving alignment of children, by dynamic programming); partners have equal paths, so whatever it finds on all
pages of a host the counts find, too.

What varies from page to page and still is no content goes by element: menus, headers, footers, asides, forms,
scripts, styles, dialogs, and elements whose class, id or role says advert, notice, comment or the like; if an
article or main element with text remains, its blocks alone are content, and template is taken from them only if
it stands outside an article.

Nulls: a null html is empty, its text "". A null url, or one without `://`, is of an empty host. Unclosed and
misnested tags are closed as browsers do for paragraphs and list items; any other stray end tag is ignored. Trees of any depth are
walked without recursion. Repeated rows are extracted one by one; equal pages count once. Empty tables give no rows; further columns are
ignored. Counts are added up within tasks before they are shuffled by block, wrappers are joined to pages by host (broadcast where their
measured size is small), and no host's pages are gathered in one task. Blocks and paths are told apart by 96-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import broadcast_if_small, written

#: Template is on so many different pages at least, and on this share of the pages of its slot or layout.
MIN_PAGES, SHARE = 3, 0.8

#: Elements without end, and elements whose text isn't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg canvas math head title select option button datalist audio video map".split())
#: Elements that are boilerplate, and those that hold a page's content.
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
CONTENT = frozenset("article main".split())
#: Elements within a block; all others begin and end one.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the first kind is closed by the start of one of the second.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
#: Words of a class, id or role that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus discussion reply replies respond "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager search copyright complementary contentinfo".split()
)
_NAME = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "parent", "children", "text", "drop", "hidden", "inside", "lang")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.parent = tag, name, parent
        self.children: list[Node] = []
        self.text = self.lang = ""
        self.drop = parent.drop if parent else False
        self.hidden = parent.hidden if parent else False
        self.inside = parent.inside if parent else False


class _Builder(HTMLParser):
    """Builds the tree. Text goes to leaves of tag `#`; a leaf's text ends where a block begins or ends."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None)
        self.piece: list[str] = []

    def flush(self) -> None:
        text = _BLANKS.sub(" ", "".join(self.piece)).strip()
        self.piece.clear()
        if text:
            leaf = Node("#", "", self.at)
            leaf.text = text
            self.at.children.append(leaf)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "br":
                self.piece.append(" ")
            if tag in VOID or not _boilerplate(attrs, self.at.inside):
                return
        # an open p, li, ... ends here; the search stops at an element that bounds it
        up = self.at
        while up.parent and up.tag not in ("div", "article", "section", "main", "body", "table", "ul", "ol", "dl", "td", "th", "blockquote", "nav", "aside", "header", "footer", "form"):
            if tag in CLOSED_BY.get(up.tag, ()):
                self.flush()
                self.at = up.parent
                break
            up = up.parent
        self.flush()
        if tag == "html" and not self.root.lang:
            self.root.lang = next((v for k, v in attrs if k == "lang" and v), "").lower().split("-")[0].strip()
        if tag in ("li", "dt", "dd", "tr", "td", "th") and self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        name = " ".join(v for k, v in attrs if k == "class" and v)
        node = Node(tag, name, self.at)
        node.drop = node.drop or tag in HIDDEN or tag in BOILERPLATE or (tag not in ("html", "body", *CONTENT) and _boilerplate(attrs, node.inside))
        node.hidden = node.hidden or tag in HIDDEN
        node.inside = node.inside or tag in CONTENT
        if tag == "header" and self.at.inside and not self.at.drop and not _boilerplate(attrs, True):
            node.drop = False  # an article's own heading
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        up = self.at
        while up.parent and up.tag != tag:
            up = up.parent
        if not up.parent:
            return  # a stray end tag, or the end of an inline element
        self.flush()
        self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.piece.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def _boilerplate(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether attributes name boilerplate or hide the element. Within an article a `header` is its heading."""
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            if (NAMES.intersection(_NAME.findall(value.lower()))) - ({"header", "masthead"} if inside else set()):
                return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and re.search(r"display\s*:\s*none", value.lower())):
            return True
    return False


def tree(html: str | None) -> Node:
    builder = _Builder()
    if html:
        last = html.rfind("<!--")
        if last >= 0 and html.find("-->", last + 4) < 0 and html.find("</script", last) < 0:
            html = html[:last]  # a comment that never ends hides the rest
        builder.feed(html)
        builder.close()
    builder.flush()
    return builder.root


def leaves(root: Node) -> Iterator[Node]:
    """The text leaves that a reader may see, in page order, boilerplate among them."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "#":
            if not node.hidden:
                yield node
        else:
            stack += reversed(node.children)


def path_of(leaf: Node) -> str:
    """Tags and classes from the root to a leaf."""
    steps, node = [], leaf.parent
    while node and node.tag:
        steps.append(f"/{node.tag}.{node.name}")
        node = node.parent
    return "".join(reversed(steps))


def kept_leaves(found: list[Node]) -> list[Node]:
    """Of leaves those that the element rules leave: of article or main elements if there are any, else all."""
    found = [n for n in found if not n.drop]
    return [n for n in found if n.inside] or found


# ---- simple tree matching --------------------------------------------------------------------------------------------


def _same(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.name == b.name


def _table(rows: list[Node], columns: list[Node], sizes: dict[tuple[int, int], int]) -> list[list[int]]:
    """best[i][k]: the most that the first i rows and the first k columns can match, in order."""
    best = [[0] * (len(columns) + 1)]
    for x in rows:
        last, now = best[-1], [0]
        for k, y in enumerate(columns):
            now.append(max(last[k + 1], now[k], last[k] + sizes.get((id(x), id(y)), 0)))
        best.append(now)
    return best


def match(a: Node, b: Node, cells: list[int] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Size and pairs of the largest order-preserving top-down match of two trees. cells[0] goes down by the cells of all tables."""
    if not _same(a, b):
        return 0, []
    # all pairs of nodes that may match, parents before children
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        by_kind: dict[tuple[str, str], list[Node]] = {}
        for d in y.children:
            by_kind.setdefault((d.tag, d.name), []).append(d)
        todo += [(c, d) for c in x.children for d in by_kind.get((c.tag, c.name), ())]
    sizes: dict[tuple[int, int], int] = {}
    for x, y in reversed(pairs):
        if x.tag == "#":  # of leaves, those with the same text are preferred
            sizes[id(x), id(y)] = 3 if x.text == y.text else 1
        else:
            sizes[id(x), id(y)] = _table(x.children, y.children, sizes)[-1][-1] + 1
            if cells is not None:
                cells[0] -= len(x.children) * len(y.children)
    matched, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        matched.append((x, y))
        best = _table(x.children, y.children, sizes)
        i, k = len(x.children), len(y.children)
        while i and k:
            if best[i][k] == best[i - 1][k]:
                i -= 1
            elif best[i][k] == best[i][k - 1]:
                k -= 1
            else:
                i, k = i - 1, k - 1
                todo.append((x.children[i], y.children[k]))
    return sizes[id(a), id(b)], matched


def induce(pages: list[str]) -> list[tuple[str, str]]:
    """(path, text) of the template blocks that different pages of a host share."""
    trees = [tree(p) for p in dict.fromkeys(pages)]
    if len(trees) < MIN_PAGES:
        return []
    constant: set[int] | None = None
    for other in trees[1:]:
        _, pairs = match(trees[0], other)
        same = {id(x) for x, y in pairs if x.tag == "#" and x.text == y.text}
        constant = same if constant is None else constant & same
    return sorted({(path_of(n), n.text) for n in leaves(trees[0]) if id(n) in constant and not n.inside})


def text_of(html: str | None, template: set[tuple[str, str]]) -> str:
    """The text of a page without the blocks of (path, text) in the template."""
    found = [n for n in leaves(tree(html)) if not template or n.inside or (path_of(n), n.text) not in template]
    return "\n\n".join(n.text for n in kept_leaves(found))


# ---- wrappers by counts ----------------------------------------------------------------------------------------------


def _key(*parts: str) -> str:
    return blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def slots(root: Node) -> Iterator[tuple[str, str, Node]]:
    """(group of pages, block) of each leaf that may be template, as keys: a leaf's groups are its slot and its page's layout."""
    outside, stack = [], [("", root)]
    while stack:
        path, node = stack.pop()
        if node.hidden or node.inside:
            continue
        if node.tag == "#":
            outside.append((path, node))
        else:
            here = _key(path, node.tag, node.name)
            stack += [(here, c) for c in reversed(node.children)]
    layout = _key(root.lang, "layout", *sorted({path for path, _ in outside})) if outside else ""
    for path, n in outside:
        for group in (_key(root.lang, "slot", path), layout):
            yield group, _key(group, path, n.text), n


def extracted_text(html: str | None, template: frozenset[str]) -> str:
    """The text of a page without the blocks that its host's template has."""
    root = tree(html)
    gone = {id(n) for _, block, n in slots(root) if block in template} if template else ()
    return "\n\n".join(n.text for n in kept_leaves([n for n in leaves(root) if id(n) not in gone]))


# ---- the distributed operator ------------------------------------------------------------------------------------------


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template (keys of blocks) of the hosts with a template."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                b = whole.slice(at, 200)
                rows: list[tuple[str, str, str, int]] = []
                for host, html, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    seen = {(group, block) for group, block, _ in slots(tree(html))}
                    # an empty block counts the pages of the group
                    rows += [(host, group, block, page) for group, block in sorted(seen | {(g, "") for g, _ in seen})]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "group", "block", "page"])

    usable = pages.filter(F.col("html").isNotNull()).select("host", "html", F.xxhash64("html").alias("page"))
    blocks = usable.mapInArrow(counted, "host string, group string, block string, page long").distinct()
    counts = written(blocks.groupBy("host", "group", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES), "blocks")
    totals = counts.filter("block = ''").select("host", "group", F.col("n").alias("total"))
    template = counts.filter("block <> ''").join(totals, ["host", "group"]).filter(F.col("n") >= SHARE * F.col("total"))
    return template.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("block")), ",").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    found = hosted.join(broadcast_if_small(wrappers(hosted), "wrappers", "host", "template"), "host", "left").select("page_id", "url", "html", "template")
    kind = dict(pages.dtypes)["page_id"]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, frozenset[str]] = {None: frozenset()}
        for b in batches:
            texts = []
            for html, template in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if template not in known:
                    if len(known) > 2000:
                        known = {None: frozenset()}
                    known[template] = frozenset(template.split(","))
                texts.append(extracted_text(html, known[template]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return found.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars bigint")
