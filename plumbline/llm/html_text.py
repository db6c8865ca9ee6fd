"""Visible text of HTML pages, laid out as a reader would see it.

A page becomes a small tree (end tags that HTML lets authors leave out are
implied), and the tree is rendered by rules of visibility and layout: blocks
stand apart, list items have bullets or numbers, table cells are padded to
aligned columns, preformatted text keeps its spaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object svg math canvas audio video datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option optgroup".split())
#: Blocks with an empty line before and behind.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table article section main header footer nav aside figure form".split())
#: A start tag of the first kind ends an open element of the second, within the nearest of the third.
IMPLIED = [
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"table"})),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), frozenset({"table"})),
    (frozenset({"tbody", "thead", "tfoot"}), frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    (frozenset({"option", "optgroup"}), frozenset({"option"}), frozenset({"select", "datalist"})),
    (BLOCK - {"body", "html", "td", "th", "tr", "li", "dd", "dt", "tbody", "thead", "tfoot", "caption"}, frozenset({"p"}), frozenset({"td", "th", "table", "li", "button"})),
]
SECTIONS = frozenset({"tbody", "thead", "tfoot"})
#: In a table, a start tag of these ends all that is open within the nearest element of the value.
IN_TABLE = {
    **dict.fromkeys(("caption", "colgroup", *SECTIONS), frozenset({"table"})),
    "col": frozenset({"table", "colgroup"}),
    "tr": frozenset({"table", *SECTIONS}),
    **dict.fromkeys(("td", "th"), frozenset({"table", "tr", *SECTIONS})),
}
CELLS = frozenset({"td", "th"})
# HTML itself takes no greater spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_SPACE = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\b", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attrs", "children", "shown")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.shown = not (
            tag in HIDDEN
            or "hidden" in attrs
            or (attrs.get("aria-hidden") or "").strip().lower() == "true"
            or (tag == "input" and (attrs.get("type") or "").lower() == "hidden")
            or _INVISIBLE.search(attrs.get("style") or "")
        )


class TreeBuilder(HTMLParser):
    """Builds the tree; unclosed and misnested elements end where an outer one does."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        #: Where in open each tag stands, so that no depth of nesting makes a search long.
        self.at: dict[str, list[int]] = defaultdict(list)

    def _nearest(self, tags) -> int:
        """Where the innermost open element of one of the tags is; 0 (the root) if none is open."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def _close(self, k: int) -> None:
        """Ends the open elements from place k on."""
        while len(self.open) > k:
            self.at[self.open.pop().tag].pop()

    def _begin(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if node.tag not in VOID:
            self.at[node.tag].append(len(self.open))
            self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for begins, ends, within in IMPLIED:
            if tag in begins:
                while (k := self._nearest(ends)) > self._nearest(within):
                    self._close(k)
        if tag in IN_TABLE and self.at["table"]:
            self._close(self._nearest(IN_TABLE[tag]) + 1)
            if tag in CELLS and self.open[-1].tag != "tr":
                self._begin(Node("tr", {}))
        self._begin(Node(tag, dict(reversed(attrs))))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML, <p/> opens a paragraph

    def handle_endtag(self, tag: str) -> None:
        k = self._nearest((tag,))
        if k and (tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or k >= self._nearest(("td", "th", "table"))):
            self._close(k)

    def handle_data(self, data: str) -> None:
        if data:
            self.open[-1].children.append(data)


class Page:
    """Text written line by line; spaces collapse and asked-for empty lines don't add up."""

    def __init__(self, item: bool = False):
        self.item = item  # of a list: lists in it stand close
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.space = False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.line += (" " if self.space and self.line else "") + first
            self.space = False
            for more in rest:
                self.flush(keep=True)
                self.line = more
            return
        for k, word in enumerate(_SPACE.split(data)):
            self.space |= k > 0
            if word:
                self.line += (" " if self.space and self.line else "") + word
                self.space = False

    def flush(self, keep: bool = False) -> None:
        if self.line.strip() or (keep and self.lines):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap |= spaced

    def put(self, lines: list[str]) -> None:
        for line in lines:
            self.line = line
            self.flush(keep=True)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _number(value: str | None, default: int, most: int) -> int:
    found = re.match(r"\s*(-?\d{1,6})", value or "")
    return min(int(found[1]), most) if found else default


# Rendering is by generators that yield the parts to be rendered next: nesting of any depth needs no recursion.
Steps = Iterator["Steps"]


def _run(steps: Steps) -> None:
    stack = [steps]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        else:
            stack.append(part)


def _parts(node: Node) -> tuple[list[tuple[Node, Node]], list[Node | str]]:
    """The shown rows of a table, each with its section, and whatever of it is in no cell, in order."""
    rows, stray = [], []
    left = [(c, node) for c in reversed(node.children)]
    while left:
        child, section = left.pop()
        if isinstance(child, str):
            stray.append(child)
        elif child.shown:
            if child.tag == "tr" or child.tag in SECTIONS:
                if child.tag == "tr":
                    rows.append((child, section))
                else:
                    section = child
                left += [(c, section) for c in reversed(child.children) if not (child.tag == "tr" and isinstance(c, Node) and c.tag in CELLS)]
            elif child.tag not in ("col", "colgroup"):
                stray.append(child)
    return rows, stray


def _table(node: Node, page: Page) -> Steps:
    """Rows of cells in aligned columns, two blanks apart; what isn't in a cell stands before the table.

    A cell that spans columns or rows stands in the first of them, and later
    cells keep clear of it. Columns without text are left out.
    """
    rows, stray = _parts(node)
    for child in stray:
        if isinstance(child, str):
            page.text(child, False)
        else:
            yield _render(child, page, False)
    page.flush()
    grid: list[dict[int, list[str]]] = []
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # columns that cells of rows before reach into, and for how many rows yet
    last = None
    for row, section in rows:
        if section is not last:
            taken, last = {}, section
        cells, column, down = {}, 0, {}
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in CELLS and cell.shown:
                while column in taken:
                    column += 1
                inner = Page()
                yield _children(cell, inner, False)
                cells[column] = inner.done()
                widths[column] = max(widths.get(column, 0), *map(_width, cells[column] or [""]))
                wide = max(1, _number(cell.attrs.get("colspan"), 1, MOST_COLUMNS))
                deep = _number(cell.attrs.get("rowspan"), 1, MOST_ROWS)
                if deep != 1:
                    down.update(dict.fromkeys(range(column, column + wide), deep if deep > 0 else MOST_ROWS))
                column += wide
        taken = {c: n - 1 for c, n in {**taken, **down}.items() if n > 1}
        if cells:
            grid.append(cells)
    columns = sorted(c for c, w in widths.items() if w)
    for cells in grid:
        for at in range(max(map(len, cells.values()))):
            parts = [cells[c][at] if c in cells and at < len(cells[c]) else "" for c in columns]
            line = "  ".join(p + " " * (widths[c] - _width(p)) for p, c in zip(parts, columns)).rstrip()
            if line or at:
                page.put([line])


def _children(node: Node, page: Page, pre: bool) -> Steps:
    for child in node.children:
        if isinstance(child, str):
            page.text(child, pre)
        elif child.shown:
            yield _render(child, page, pre)


def _indented(node: Node, page: Page, pre: bool, mark: str) -> Steps:
    inner = Page(item=node.tag == "li")
    yield _children(node, inner, pre)
    lines = inner.done()
    page.put([(mark if not k else " " * len(mark)) + line if line else "" for k, line in enumerate(lines)])


def _render(node: Node, page: Page, pre: bool) -> Steps:
    tag = node.tag
    if tag == "br":
        page.flush(keep=True)
    elif tag == "hr":
        page.block(True)
        page.put(["---"])
        page.block(True)
    elif tag == "wbr":
        return
    elif tag == "img":
        page.text(node.attrs.get("alt") or "", False)
    elif tag == "textarea":
        page.block(False)
        yield _children(node, page, True)
        page.block(False)
    elif tag not in BLOCK:
        yield _children(node, page, pre)
    else:
        nested = page.item and tag in ("ul", "ol", "menu", "dir")
        page.block(tag in SPACED and not nested)
        if tag == "table":
            yield _table(node, page)
        elif tag in ("ul", "menu", "dir", "ol"):
            count = _number(node.attrs.get("start"), 1, 10**6)
            for child in node.children:
                if isinstance(child, Node) and child.tag == "li":
                    count = _number(child.attrs.get("value"), count, 10**6)
                    if child.shown:
                        page.flush()
                        yield _indented(child, page, pre, f"{count}. " if tag == "ol" else "- ")
                    count += 1
                elif isinstance(child, str):
                    page.text(child, pre)
                elif child.shown:
                    yield _render(child, page, pre)
        elif tag in ("blockquote", "dd"):
            yield _indented(node, page, pre, "  ")
        else:
            yield _children(node, page, pre or tag == "pre")
        page.block(tag in SPACED and not nested)


def render(html: str | None) -> str:
    """The visible text of a page; '' for null. A malformed page gives what can be read of it."""
    builder = TreeBuilder()
    builder.feed((html or "").replace("\x00", ""))
    builder.close()
    page = Page()
    _run(_children(builder.root, page, False))
    lines = page.done()
    while lines and not lines[0]:
        del lines[0]
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    text: visible text with blocks, lists and aligned tables; '' for null, empty
    or invisible pages, never null. Pages of any length and depth are rendered
    whole, one by one, wherever they lie; repeated rows each get their row; other
    columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
