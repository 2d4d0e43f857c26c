"""Visible text of HTML pages, laid out: a small tree builder, then block-wise rendering.

The builder knows void elements and implied end tags, ignores stray end tags, and closes what
is open at the end.  Rendering drops what a browser does not show, collapses white space
outside ``pre``, parts blocks by line breaks or blank lines, numbers or marks list items, and
pads table cells to the width of their column.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: fixed values of the HTML standard: elements without content, unseen ones, and blocks
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript meta link base datalist audio video canvas iframe object select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header html legend li main nav option section summary caption thead tbody tfoot tr td th".split())
#: a start tag of the key ends an open element of the values, looked for up to the barrier
IMPLIED = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "caption"), ("table",)),
    "thead": (("caption", "tbody"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
GROUPS = ("thead", "tbody", "tfoot")
#: a start tag of the key closes all that is open inside the innermost of the values, if there is one
INSIDE = {
    **dict.fromkeys((*GROUPS, "caption", "colgroup"), ("table",)),
    "col": ("colgroup", "table"),
    "tr": (*GROUPS, "table"),
    **dict.fromkeys(("td", "th"), ("tr", *GROUPS, "table")),
}
#: what a head may hold; any other start tag or text ends it
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript noframes template head html".split())
SCOPES = frozenset("table td th caption body html".split())
#: a block ends an open paragraph, looked for up to these
P_SCOPES = SCOPES | {"li", "div", "article", "section"}
FOREIGN = ("svg", "math")
#: elements of a drawing whose content is drawn, and those that only group others
DRAWN, GROUPING = ("text", "foreignobject"), ("svg", "g", "a", "switch")
REMOVED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
BLOCK_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*(?:block|flex|grid|flow-root|list-item|table)\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: a tag that no ">" follows, up to the end of the page
UNENDED = re.compile(r"<[A-Za-z/!?][^>]*\Z")
CALLS_PER_LEVEL = 8
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; ``seen`` is false if it is left out with all inside it.

    ``visible`` says whether its own text shows: elements inherit it and may set it anew.
    """

    __slots__ = ("tag", "attrs", "children", "seen", "visible", "is_block")

    def __init__(self, tag: str, attrs: dict[str, str | None], visible: bool = True):
        self.tag, self.attrs, self.children = tag, attrs, []
        style = attrs.get("style") or ""
        self.seen = not (tag in UNSEEN or "hidden" in attrs or style and REMOVED.search(style))
        said = VISIBILITY.findall(style) if style else ()
        self.visible = said[-1].lower() == "visible" if said else visible
        self.is_block = tag in BLOCKS or bool(style and BLOCK_STYLE.search(style))


class TreeBuilder(HTMLParser):
    """Builds the tree.  Where elements of a tag are open is kept, so no tag is looked for in the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.depth = 1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` is a comment up to the next ``>``."""
        return self.parse_bogus_comment(i)

    def innermost(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)
        self.depth = max(self.depth, len(self.open))

    def pop(self, size: int) -> None:
        """Close elements until ``size`` are open."""
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()

    def close_to(self, tags: tuple[str, ...], barrier: frozenset | tuple) -> None:
        at = self.innermost(tags)
        if at and at >= self.innermost(barrier):
            self.pop(at)

    def close_inside(self, tags: tuple[str, ...]) -> None:
        at = self.innermost(tags)
        if at:
            self.pop(at + 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self.pop(len(self.open) - 1)
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.pop(len(self.open) - 1)
        if tag in INSIDE:
            self.close_inside(INSIDE[tag])
            if tag in ("td", "th") and self.open[-1].tag in (*GROUPS, "table"):
                self.handle_starttag("tr", [])
        if tag in IMPLIED:
            self.close_to(*IMPLIED[tag])
        elif tag in BLOCKS:
            self.close_to(("p",), P_SCOPES)
        node = Node(tag, dict(attrs), self.open[-1].visible)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """The slash means something in drawings and formulas only."""
        self.handle_starttag(tag, attrs)
        if self.innermost(FOREIGN) and self.open[-1].tag == tag:
            self.pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}, self.open[-1].visible))
        elif tag == "tr" or tag in GROUPS:
            self.close_to((tag,), ("table",))
        elif tag not in VOID:
            self.close_to((tag,), () if tag in SCOPES else ("td", "th", "caption"))

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag in ("head", "colgroup") and BLANKS.sub("", data):
            self.pop(len(self.open) - 1)
        self.open[-1].children.append(data)


class Page:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap = "", 0

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self.put(first)
            for part in rest:
                self.break_line()
                self.put(part)
            return
        data = BLANKS.sub(" ", data)
        if not self.line or self.line.endswith(" "):
            data = data.lstrip(" ")
        if data:
            self.put(data)

    def put(self, data: str) -> None:
        if data and self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        if data:
            self.gap = 0
        self.line += data

    def break_line(self) -> None:
        """End the line, even an empty one."""
        self.lines.append(self.line.rstrip())
        self.line = ""

    def part(self, gap: int) -> None:
        """End the line if there is one; the next text comes after ``gap`` line ends at least."""
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        self.line = ""
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.part(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines

    def block(self, lines: list[str], gap: int) -> None:
        self.part(gap)
        if lines:
            self.put(lines[0])
            self.lines += [self.line, *lines[1:]]
            self.line, self.gap = "", gap


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else default


def _rendered(node: Node, keep: bool) -> list[str]:
    page = Page()
    _children(node, page, keep)
    return page.done()


def _children(node: Node, page: Page, keep: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            if node.visible:
                page.text(child, keep)
        elif child.seen:
            _element(child, page, keep)


def _drawn(node: Node) -> Iterator[Node]:
    """The elements of a drawing that hold its text, in order."""
    waiting = [node]
    while waiting:
        found = waiting.pop()
        if found.tag in DRAWN:
            yield found
        elif found.tag in GROUPING:
            waiting += [c for c in reversed(found.children) if isinstance(c, Node) and c.seen]


def _element(node: Node, page: Page, keep: bool) -> None:
    tag = node.tag
    if tag == "br":
        page.break_line()
    elif tag == "img":
        page.text(node.attrs.get("alt") or "" if node.visible else "", False)
    elif tag == "svg":
        for inner in _drawn(node):
            page.part(1)
            _children(inner, page, keep)
            page.part(1)
    elif tag in ("ul", "ol"):
        page.block(_items(node, keep), 1 if page_is_nested(node) else 2)
    elif tag == "table":
        page.block(_table(node, keep), 2)
    elif tag == "details" and "open" not in node.attrs:
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary" and child.seen:
                _element(child, page, keep)
    elif node.is_block:
        gap = 2 if tag in SPACED else 1
        page.part(gap)
        _children(node, page, keep or tag == "pre")
        page.part(gap)
    else:
        _children(node, page, keep)


def page_is_nested(node: Node) -> bool:
    return "#nested" in node.attrs


def _items(node: Node, keep: bool) -> list[str]:
    """List items behind a mark or number; later lines of an item are indented as far."""
    out: list[str] = []
    number = _number(node.attrs.get("start"), 1)
    for child in node.children:
        if isinstance(child, str):
            out += [BLANKS.sub(" ", child).strip()] if node.visible and child.strip() else []
            continue
        if not child.seen:
            continue
        if child.tag != "li":
            out += _rendered_node(child, keep)
            continue
        for inner in child.children:
            if isinstance(inner, Node) and inner.tag in ("ul", "ol"):
                inner.attrs["#nested"] = None
        number = _number(child.attrs.get("value"), number)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        lines = _rendered(child, keep)
        if lines:
            out += [mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])]
    return out


def _rendered_node(node: Node, keep: bool) -> list[str]:
    page = Page()
    _element(node, page, keep)
    return page.done()


def _rows(node: Node) -> Iterator[Node]:
    """The rows of a table in order: head, bodies, foot as written, none of inner tables."""
    for child in node.children:
        if isinstance(child, Node) and child.seen:
            if child.tag == "tr":
                yield child
            elif child.tag in GROUPS:
                yield from _rows(child)


def _loose(node: Node) -> Iterator[Node | str]:
    """Text and elements outside the cells of a table, caption included, as written."""
    for child in node.children:
        if isinstance(child, str):
            if node.visible:
                yield child
        elif child.seen and (child.tag == "tr" or child.tag in GROUPS):
            yield from _loose(child)
        elif child.seen and child.tag not in ("td", "th", "colgroup"):
            yield child


def _table(node: Node, keep: bool) -> list[str]:
    """Caption, loose content, then rows with their cells padded to the column's width."""
    loose = Node("#loose", {})
    loose.children = list(_loose(node))
    out = _rendered(loose, False)
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in _rows(node):
        cells: dict[int, tuple[list[str], int]] = {}
        at = 0
        covered, held = held, {c: n - 1 for c, n in held.items() if n > 1}
        for cell in row.children:
            if not isinstance(cell, Node) or not cell.seen or cell.tag not in ("td", "th"):
                continue
            while covered.get(at):
                at += 1
            span = max(1, min(1000, _number(cell.attrs.get("colspan"), 1)))
            down = max(1, min(65534, _number(cell.attrs.get("rowspan"), 1)))
            cells[at] = (_rendered(cell, keep), span)
            for c in range(at, at + span):
                if down > 1:
                    held[c] = down - 1
            at += span
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for at, (lines, span) in cells.items():
            if span == 1:
                width[at] = max([width.get(at, 0), *map(len, lines)])
    for cells in grid:
        for at, (lines, span) in cells.items():
            spare = max(map(len, lines), default=0) - sum(width.get(c, 0) + 3 for c in range(at, at + span)) + 3
            if span > 1 and spare > 0:
                width[at + span - 1] = width.get(at + span - 1, 0) + spare
    starts, last = [0], max((max(cells) for cells in grid if cells), default=0)
    for c in range(last):
        starts.append(starts[-1] + width.get(c, 0) + 3)
    for cells in grid:
        places = sorted(cells)
        for i in range(max((len(lines) for lines, _ in cells.values()), default=0)):
            parts, size = [], 0
            for at in places:
                lines = cells[at][0]
                mark = " | " if parts else ""
                text = " " * (starts[at] - len(mark) - size) + mark + (lines[i] if i < len(lines) else "")
                parts.append(text)
                size += len(text)
            out.append("".join(parts).rstrip())
    return out


def visible_text(html: str | None) -> str:
    """The laid out text of a page.

    Frames of nested calls live on the heap, so the call depth may follow the page's; it is set
    back afterwards.  A tag that the page's end cuts off is left out, as browsers do.
    """
    builder = TreeBuilder()
    text = html or ""
    tail = text.rfind(">") + 1
    cut = UNENDED.search(text, tail)
    builder.feed(text[: cut.start()] if cut else text)
    builder.close()
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + CALLS_PER_LEVEL * builder.depth)
    try:
        return "\n".join(_rendered(builder.root, False))
    finally:
        sys.setrecursionlimit(limit)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every row of ``pages``.

    Null and empty pages give the empty text; null page_ids and repeated rows are kept; other
    columns are ignored; no element is too deep or too long.  No shuffle.
    """

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x.as_py()) for x in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(
        lay_out, "page_id long, text string, n_chars long, n_lines long"
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
