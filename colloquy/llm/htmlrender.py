"""HTML to text, laid out as a page shows it.

A tree builder closes what the markup leaves open (paragraphs before blocks,
list items, table rows and cells, options) and opens the rows that a table
implies. Visibility rules drop what is never shown (head, scripts, templates,
comments, form state) and what markup or simple style rules hide (``hidden``,
``display: none``, ``visibility: hidden``, closed ``details``). The rest is
emitted whole: blocks on lines of their own with blank lines where margins
are, lists with their bullets or numbers, indented by level, ``pre`` as it
stands, tables with aligned columns.

Defined cases: a null page gives null, an empty page or one without visible text
an empty string; markup of any depth keeps its layout; repeated rows are rendered
each; pages of any length are read whole, in time and memory in proportion to
them and to what is laid out, whose indents and blanks two parameters can bound; a page that ends within a tag
or comment ends before it, as in browsers; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, ship_package, text_groups

# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template noscript title meta link canvas audio video iframe object embed datalist annotation annotation-xml".split()) - {"head"}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div article section nav main header footer aside address form li dt dd figcaption legend details summary center menu dialog hgroup search tr td th caption thead tbody tfoot".split())
CLOSES_P = (SPACED | frozenset("div article section nav main header footer aside address form center details dialog menu summary".split())) - {"html", "body"}
#: Opening the first closes an open one of the second, up to the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("td", "th", "tr"), ("table",)),
    "thead": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)), "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)), "tfoot": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)), "body": (("head",), ("html",)),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
SPACE = re.compile(r"[ \t\n\r\f]+")
#: What an ``svg`` holds without showing it where it stands.
SVG_UNSHOWN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)", re.I)
ON_SCREEN = re.compile(r"@media\s*(?:(?:only\s+)?(?:screen|all)\s*(?:,[^{}]*)?)?", re.I)
SIMPLE = re.compile(r"(?:[a-z][a-z0-9]*)?(?:[.#][\w-]+)?", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder:
    """A tree of a page; ``styles`` gathers the text of its style elements.

    Which elements are open is known by tag as well as by depth, so that no tag
    takes a search through all that is open. A tree may be of any depth.
    """

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.styles: list[str] = []

    def _last(self, *tags: str) -> int:
        """Depth of the innermost open element of these tags, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _cut(self, depth: int) -> None:
        """Close all that is open from a depth on."""
        while len(self.open) > max(1, depth):
            self.places[self.open.pop().tag].pop()

    def _close(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Close the open elements of the tags within the innermost limit: an outer one may be open too, a row above its cell."""
        while (at := self._last(*tags)) > max(0, self._last(*limits)):
            self._cut(at)

    def _push(self, node: Node, stays: bool = True) -> None:
        self.open[-1].children.append(node)
        if stays:
            self.places.setdefault(node.tag, []).append(len(self.open))
            self.open.append(node)

    def foreign(self) -> bool:
        """Whether a drawing or formula is open."""
        return self._last("svg", "math") > 0

    def start(self, tag: str, values: dict[str, str], closed: bool) -> None:
        if tag == "html":
            self.root.attrs = values | self.root.attrs
            return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY and tag != "head":
            self._cut(len(self.open) - 1)
        if tag in CLOSES_P and self.places.get("p"):
            self._close(("p",), ("td", "th", "table", "button", "object", "body"))
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self._last("tr") <= self._last("table"):
            self._push(Node("tr", {}))
        self._push(Node(tag, values), tag not in VOID and not (closed and self.foreign()))

    def end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                self._push(Node("br", {}), False)
            return
        at = self._last(tag)
        if at > 0 and (tag in ("table", "tr", "thead", "tbody", "tfoot") or self._last("table", "td", "th") <= at):
            self._cut(at)
        elif tag == "p":
            self._push(Node("p", {}), False)

    def data(self, text: str) -> None:
        top = self.open[-1]
        if top.tag == "style":
            self.styles.append(text)
            return
        if top.tag == "head":
            if not text.strip():
                return
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(text)


# Elements whose text is taken as it stands, and those in which only references are read.
AS_IT_STANDS = frozenset("script style xmp iframe noembed noframes noscript".split())
REFERENCES_ONLY = frozenset("textarea title".split())
TAG_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
ATTRIBUTE = re.compile(r"[\t\n\f\r /]*([^\t\n\f\r />=][^\t\n\f\r />=]*|=[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*(=)[\t\n\f\r ]*)?")
TAG_END = re.compile(r"[\t\n\f\r ]*(/?)[\t\n\f\r /]*>")
BARE_VALUE = re.compile(r"[^\t\n\f\r >]*")
COMMENT_END = re.compile(r"--!?>")
ENDS = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in AS_IT_STANDS | REFERENCES_ONLY}


def _attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """``(attributes, whether closed, place behind the tag)``; a tag that the page ends in reaches to its end."""
    values: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(html, at)
        if m is None:
            end = TAG_END.match(html, at)
            return values, bool(end and "/" in end[0]), end.end() if end else len(html)
        name, at, value = m[1].lower(), m.end(), ""
        if m[2]:
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote:
                stop = html.find(quote, at + 1)
                if stop < 0:
                    return values, False, len(html)
                value, at = html[at + 1 : stop], stop + 1
            else:
                bare = BARE_VALUE.match(html, at)
                value, at = bare[0], bare.end()  # type: ignore[index,union-attr]
        values.setdefault(name, unescape(value) if "&" in value else value)


def build(html: str) -> TreeBuilder:
    """The tree of a page, in one pass: every search goes on from where the last one ended."""
    tree, at, n = TreeBuilder(), 0, len(html)

    def behind(text: str, start: int) -> int:
        found = html.find(text, start)
        return n if found < 0 else found + len(text)

    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            tree.data(unescape(html[at:mark]))
        at = mark
        if at == n:
            break
        name = TAG_NAME.match(html, at + 1)
        if name:
            tag = name[0].lower()
            values, closed, at = _attributes(html, name.end())
            if at == n and html[-1] != ">":
                break
            foreign = tree.foreign()
            tree.start(tag, values, closed)
            if tag in ENDS and not foreign:
                end = ENDS[tag].search(html, at)
                text = html[at : end.start() if end else n]
                tree.data(unescape(text) if tag in REFERENCES_ONLY else text)
                tree.end(tag)
                at = behind(">", end.end()) if end else n
            elif tag == "plaintext":
                tree.data(html[at:])
                at = n
        elif html.startswith("</", at):
            name = TAG_NAME.match(html, at + 2)
            at = behind(">", at)
            if name:
                tree.end(name[0].lower())
        elif html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                at = behind(">", at)
            else:
                stop = COMMENT_END.search(html, at + 4)
                at = stop.end() if stop else n
        elif html.startswith("<![CDATA[", at) and tree.foreign():
            stop = html.find("]]>", at)
            tree.data(html[at + 9 : stop if stop >= 0 else n])
            at = stop + 3 if stop >= 0 else n
        elif html.startswith(("<!", "<?"), at):
            at = behind(">", at)
        else:
            tree.data("<")
            at += 1
    return tree


def hiding_selectors(styles: list[str]) -> set[str]:
    """Simple selectors (element, ``.class``, ``#id``, or an element with one) that a style sheet hides.

    The last display and the last visibility of a selector count. Rules inside
    of @-blocks are left out, save those of media that hold on any screen.
    """
    told: dict[tuple[str, str], str] = {}
    blocks: list[str] = []
    before = ""
    for part in re.split(r"([{}])", re.sub(r"/\*.*?\*/", "", "\n".join(styles), flags=re.S)):
        if part == "{":
            blocks.append(before.rpartition(";")[2].strip())
        elif part == "}":
            if blocks:
                names = blocks.pop()
                if not names.startswith("@") and all(ON_SCREEN.fullmatch(o) for o in blocks):
                    for n in names.split(","):
                        if SIMPLE.fullmatch(n.strip()):
                            told |= {(n.strip(), k.lower()): v.lower() for k, v in DECLARED.findall(before)}
            before = ""
            continue
        before = part if part != "{" else ""
    return {n for (n, k), v in told.items() if n and (v == "none" if k == "display" else v in ("hidden", "collapse"))}


Step = Iterator["Step"]


def finish(step: Step) -> None:
    """Run a step and those that it yields, which are done where it yields them: calls within calls of any depth."""
    stack = [step]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


class Renderer:
    """Lines of a tree's visible text.

    Whatever goes down the tree is a generator that yields the steps further
    down (``finish``). ``most_indent`` bounds the indent of a line, ``fill`` the
    blanks that a table's columns take for each sign of their text; without
    these the layout is exact, however wide.
    """

    def __init__(self, hidden: set[str], most_indent: int | None = None, fill: int | None = None):
        self.hidden, self.most_indent, self.fill = hidden, most_indent, fill
        self.lines: list[str] = []
        self.line = ""
        self.blank = False
        self.prefix: list[str] = []
        self.mark = ""

    def visible(self, node: Node) -> bool:
        if node.tag in NEVER or node.tag == "head" or "hidden" in node.attrs:
            return False
        if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
            return False
        if "style" in node.attrs and HIDING.search(node.attrs["style"]):
            return False
        if self.hidden:
            names = [node.tag, *(f".{c}" for c in node.attrs.get("class", "").split()), *([f"#{node.attrs['id']}"] if "id" in node.attrs else [])]
            if any(n in self.hidden or node.tag + n in self.hidden for n in names):
                return False
        return True

    def end_line(self) -> None:
        text = self.line.rstrip()
        if text:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            indent = "".join(self.prefix)
            if self.most_indent is not None:
                indent = indent[max(0, len(indent) - self.most_indent) :]
            if self.mark:
                indent = indent[: len(indent) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append(indent + text)
        self.line = ""

    def space(self) -> None:
        self.end_line()
        self.blank = True

    def text(self, data: str) -> None:
        data = SPACE.sub(" ", data)
        if not self.line or self.line.endswith((" ", "\n")):
            data = data.lstrip(" ")
        self.line += data

    def children(self, node: Node) -> Step:
        for child in node.children:
            if isinstance(child, str):
                self.text(child)
            elif self.visible(child):
                yield self.element(child)

    def element(self, node: Node) -> Step:
        tag = node.tag
        if tag == "br":
            if not self.line.strip() and self.lines and not self.blank:
                self.blank = True
            self.end_line()
        elif tag == "wbr":
            pass
        elif tag == "hr":
            self.space()
            self.line = "----"
            self.space()
        elif tag == "img":
            if node.attrs.get("alt", "").strip():
                self.text(node.attrs["alt"])
        elif tag == "input":
            if node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                self.text(node.attrs["value"])
        elif tag == "pre":
            self.space()
            raw = flat_text(node, self).removeprefix("\n").expandtabs(8)
            for line in raw.split("\n"):
                if line.strip():
                    self.line = line
                    self.end_line()
                else:
                    self.blank = bool(self.lines)
            self.space()
        elif tag in ("ul", "ol", "menu"):
            yield self.list(node)
        elif tag == "table":
            yield self.table(node)
        elif tag == "details" and "open" not in node.attrs:
            self.end_line()
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary" and self.visible(child):
                    yield self.element(child)
            self.end_line()
        elif tag == "svg":
            yield self.svg(node)
        elif tag == "textarea":
            for line in flat_text(node, self).removeprefix("\n").split("\n"):
                self.text(line)
                self.end_line()
        elif tag in ("option", "optgroup"):
            self.end_line()
            if node.attrs.get("label", "").strip():
                self.text(node.attrs["label"])
                self.end_line()
            if tag == "optgroup" or not node.attrs.get("label", "").strip():
                yield self.children(node)
            self.end_line()
        elif tag == "q":
            self.line += "“"
            yield self.children(node)
            self.line += "”"
        elif tag in SPACED:
            self.space()
            if tag == "blockquote":
                self.prefix.append("  ")
            yield self.children(node)
            self.space()
            if tag == "blockquote":
                self.prefix.pop()
        elif tag in BLOCK:
            self.end_line()
            if tag == "dd":
                self.prefix.append("  ")
            yield self.children(node)
            self.end_line()
            if tag == "dd":
                self.prefix.pop()
        else:
            yield self.children(node)

    def svg(self, node: Node) -> Step:
        """The labels of a drawing, each on a line."""
        for child in node.children:
            if isinstance(child, Node) and child.tag not in SVG_UNSHOWN and self.visible(child):
                if child.tag in ("text", "foreignobject"):
                    self.end_line()
                    yield self.children(child)
                    self.end_line()
                else:
                    yield self.svg(child)

    def list(self, node: Node) -> Step:
        nested = bool(self.prefix)
        self.end_line() if nested else self.space()
        start = node.attrs.get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str):
                self.text(child)
                continue
            if not self.visible(child):
                continue
            if child.tag != "li":
                yield self.element(child)
                continue
            self.end_line()
            own = child.attrs.get("value", "")
            if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", own):
                number = int(own)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            self.prefix.append(" " * len(mark))
            self.mark = mark
            yield self.children(child)
            self.end_line()
            self.mark = ""
            self.prefix.pop()
        self.end_line() if nested else self.space()

    def table(self, node: Node) -> Step:
        """Rows with aligned columns; a cell of several lines takes several."""
        rows: list[list[tuple[list[str], int, int]]] = []
        self.space()

        def gather(part: Node) -> Step:
            for child in part.children:
                if isinstance(child, str):
                    self.text(child)
                elif not self.visible(child):
                    continue
                elif child.tag in ("thead", "tbody", "tfoot"):
                    yield gather(child)
                elif child.tag == "tr":
                    row = []
                    for cell in child.children:
                        if isinstance(cell, str):
                            self.text(cell)
                        elif self.visible(cell):
                            if cell.tag in ("td", "th"):
                                inner = Renderer(self.hidden, self.most_indent, self.fill)
                                yield inner.children(cell)
                                inner.end_line()
                                row.append((inner.lines or [""], _span(cell, "colspan"), _span(cell, "rowspan")))
                            else:
                                yield self.element(cell)
                    rows.append(row)
                else:
                    yield self.element(child)

        yield gather(node)
        self.end_line()
        grid: list[dict[int, list[str]]] = []
        widths: dict[int, int] = {}
        taken: dict[int, int] = {}
        for row in rows:
            held = {c for c, n in taken.items() if n > 0}
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            line: dict[int, list[str]] = {}
            column, wide = 0, set()
            for text, across, down in row:
                while column in held:
                    column += 1
                line[column] = text
                if across > 1:
                    wide.add(column)
                for c in range(column, column + across):
                    if down > 1:
                        taken[c] = down - 1
                column += across
            grid.append(line)
            for c, text in line.items():
                widths[c] = max(widths.get(c, 0), *(0 if c in wide else shown_width(t) for t in text))
        columns = sorted(widths)
        dense, aligned = True, set(columns)
        if self.fill is not None:
            # A column is aligned while its blanks stay in proportion to its text.
            n_lines = sum(max((len(t) for t in line.values()), default=0) for line in grid)
            shown = {c: [shown_width(t) for line in grid for t in line.get(c, [])] for c in columns}
            dense = n_lines * len(columns) <= self.fill * sum(map(len, shown.values())) + 1000
            aligned = {c for c in columns if dense and n_lines * widths[c] <= self.fill * sum(shown[c]) + 1000}
        for line in grid:
            for i in range(max((len(t) for t in line.values()), default=0)):
                own = columns if dense else sorted(line)
                parts = [(c, line[c][i] if c in line and i < len(line[c]) else "") for c in own]
                self.line = "  ".join(t + " " * (widths[c] - shown_width(t)) if c in aligned else t for c, t in parts).rstrip()
                if self.line.strip():
                    self.end_line()
                self.line = ""
        self.space()


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "")
    return min(1000, max(1, int(value))) if re.fullmatch(r"\d{1,6}", value) else 1


def shown_width(text: str) -> int:
    """Columns that a text takes where wide characters take two."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def flat_text(node: Node, renderer: Renderer) -> str:
    """The visible text below a node as it stands."""
    parts, below = [], [iter(node.children)]
    while below:
        child = next(below[-1], None)
        if child is None:
            below.pop()
        elif isinstance(child, str):
            parts.append(child)
        elif renderer.visible(child):
            if child.tag == "br":
                parts.append("\n")
            else:
                below.append(iter(child.children))
    return "".join(parts)


def render(html: str | None, most_indent: int | None = None, fill: int | None = None) -> str | None:
    """The visible text of a page; with bounds for indents and for the blanks in tables, if they are given."""
    if html is None:
        return None
    tree = build(html)
    out = Renderer(hiding_selectors(tree.styles), most_indent, fill)
    if out.visible(tree.root):
        finish(out.children(tree.root))
    out.end_line()
    return "\n".join(out.lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_indent: int | None = None, fill: int | None = None) -> DataFrame:
    """``(id, text)`` of every row; ``most_indent`` and ``fill`` as in ``render``, for pages whose layout would be far wider than their text."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "html", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(h, most_indent, fill) for h in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return arrow_map(rows, run, "id long, text string")
