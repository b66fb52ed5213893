"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

The builder closes what a start tag implies closed (paragraphs, list items, table cells and rows,
options, headings), moves what stands loose in a table, text or elements, in front of it, and bounds
the depth of the tree. The renderer leaves out what a browser doesn't show, collapses white space as a browser
does, keeps blocks apart (a blank line where there is a margin), marks and indents list items, keeps
preformatted text, and sets table cells in aligned columns, with spans.

Hidden are elements that show no text, those with `hidden` or `display: none` and, but for what is
made visible inside, those with `visibility: hidden`; both are read from style attributes and from
rules of the page's own style elements whose selectors are a name, classes or an id, alone or joined
(no combinators, attributes, states or @-blocks). Of SVG, text elements show, of MathML all but
annotations. Reading takes time in proportion to the page, whatever stands in it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm._text import bounded_batches, slices, tidy

MAX_DEPTH = 200
MAX_SPAN = 1000
PAD_LINE, PAD_TEXT = 512, 8

#: Fixed sets of element names of the HTML standard, by how they are parsed or shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist param source track link meta base area object audio video canvas rp".split())
IN_HEAD = frozenset("html head title script style template noscript link meta base".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
MARGINS = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre listing plaintext table ul menu dir xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_ENDS = frozenset("td th table caption html template object marquee applet".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())

FOREIGN = frozenset("svg math".split())
FOREIGN_TEXT = frozenset("foreignobject annotation-xml desc title".split())  # hold ordinary elements
FOREIGN_HIDDEN = frozenset("title desc defs metadata symbol style script clippath mask pattern marker".split())
LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile("""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile("[ \t\n\f\r]+")
_DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW | ESCAPABLE_RAW}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


class Styles:
    """What rules of style elements say of `display` and `visibility`."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list] = {}  # by an id, a class or a name that the selector asks for
        order = 0
        for sheet in sheets:
            depth, head, inside = 0, "", ""
            for part in re.split("([{}])", re.sub(r"/\*.*?(?:\*/|$)", " ", sheet, flags=re.S)):
                if part == "{":
                    depth += 1
                elif part == "}":
                    if depth == 1:
                        order += 1
                        self._add(head, inside, order)
                    depth, head, inside = max(depth - 1, 0), "", ""
                elif depth == 0:
                    head = part.rpartition(";")[2]
                elif depth == 1 and not head.lstrip().startswith("@"):
                    inside = part

    def _add(self, head: str, inside: str, order: int) -> None:
        declared = [(name.lower(), value.lower(), bool(weight)) for name, value, weight in _DECLARED.findall(inside)]
        for selector in head.split(",") if declared else []:
            found = _SELECTOR.fullmatch(selector.strip())
            if not found or not found[0]:
                continue
            asked = re.findall("[.#][^.#]+", found[2])
            tag = (found[1] or "*").lower()
            weight = (sum(x[0] == "#" for x in asked), sum(x[0] == "." for x in asked), tag != "*", order)
            self.rules.setdefault(asked[0] if asked else tag, []).append((tag, frozenset(asked), weight, declared))

    def of(self, node: Node) -> dict[str, str]:
        """The values that hold for an element: of its rules and its own style."""
        a = node.attributes
        best: dict[str, tuple] = {}
        if self.rules:
            own = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())
            for key in (*own, node.tag, "*"):
                for tag, asked, weight, declared in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and asked <= own:
                        for name, value, important in declared:
                            best[name] = max(best.get(name, ()), (important, False, weight, value))
        if "style" in a:
            for name, value, important in _DECLARED.findall(a["style"]):
                best[name.lower()] = max(best.get(name.lower(), ()), (bool(important), True, (), value.lower()))
        return {name: found[3] for name, found in best.items()}


class Builder:
    """Builds the tree of one page."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.foreign = 0  # where the outermost SVG or MathML stands among the open elements, if it still does
        self.sheets: list[str] = []

    def in_foreign(self) -> bool:
        return 0 < self.foreign < len(self.open) and self.open[self.foreign].tag in FOREIGN

    def text(self, text: str) -> None:
        if not text:
            return
        if self.open[-1].tag == "colgroup" and not text.isspace():
            self.open.pop()
        top = self.open[-1]
        if top.tag in TABLE_PARTS and len(self.open) > 1:
            if text.isspace() or self._before_table(text):
                return
        if top.tag == "head":
            if text.isspace():
                return
            self.open.pop()
            top = self.open[-1]
        top.children.append(text)

    def _before_table(self, child: Node | str) -> bool:
        """Puts what stands loose in a table in front of it."""
        at = max(i for i, n in enumerate(self.open) if n.tag == "table" or i == 0)
        if at:
            before = self.open[at - 1].children
            before.insert(len(before) - 1, child)
        return at > 0

    def _leave_loose(self) -> None:
        """Closes the loose elements, or the column group, that are open in a table outside of its cells."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in TABLE_PARTS:
                del self.open[i + 1 :]
                return
            if tag in ("td", "th", "caption", "template"):
                return

    def _close(self, tags: frozenset[str] | set[str], ends: frozenset[str] | set[str]) -> bool:
        """Closes up to the nearest open element of `tags`, unless one of `ends` is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                return True
            if tag in ends:
                return False
        return False

    def _imply(self, tag: str) -> None:
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.open.pop()
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE_ENDS | {"button"})
        if tag == "li":
            self._close({"li"}, SCOPE_ENDS | {"ul", "ol", "menu", "dir"})
        elif tag in ("dd", "dt"):
            self._close({"dd", "dt"}, SCOPE_ENDS | {"dl"})
        elif tag in HEADINGS:
            if self.open[-1].tag in HEADINGS:
                self.open.pop()
        elif tag in ("option", "optgroup"):
            self._close({"option"}, {"select", "datalist", "optgroup"} | SCOPE_ENDS)
            if tag == "optgroup":
                self._close({"optgroup"}, {"select", "datalist"} | SCOPE_ENDS)
        elif tag == "a":
            self._close({"a"}, SCOPE_ENDS | BLOCKS)
        elif tag in ("td", "th"):
            self._close({"td", "th", "caption"}, {"table", "tr"})
            self._leave_loose()
            if self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
                self._push(Node("tr"))
        elif tag == "tr":
            self._close({"tr"}, {"table"}) or self._close({"caption"}, {"table"})
            self._leave_loose()
        elif tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self._close({"tbody", "thead", "tfoot", "caption"}, {"table"}) or self._close({"tr"}, {"table"})
            self._leave_loose()
        elif tag != "col" and self.open[-1].tag == "colgroup":
            self.open.pop()

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def start(self, tag: str, raw: str) -> bool:
        """Opens an element; whether it may hold anything."""
        if tag in ("html", "body"):
            if self.open[-1].tag == "head":
                self.open.pop()
            self.root.attributes = {**_attributes(raw), **self.root.attributes}
            return False
        inside = self.in_foreign()
        if inside and tag in LEAVES_FOREIGN and not any(n.tag in FOREIGN_TEXT for n in self.open[self.foreign :]):
            del self.open[self.foreign :]
            inside = False
        if not inside:
            self._imply(tag)
        node = Node(tag, _attributes(raw))
        if tag in ("annotation", "annotation-xml") and inside:
            node.attributes["hidden"] = ""
        if raw.endswith("/") and (inside or tag in FOREIGN):
            self.open[-1].children.append(node)
            return False
        if not inside and self.open[-1].tag in TABLE_PARTS and tag not in IN_TABLE:
            if tag == "table":  # a table directly in another one ends it
                self.end("table")
            elif tag == "form" and any(n.tag == "table" for n in self.open):
                return False  # holds nothing there: its rows and cells are the table's
            elif self._before_table(node):
                if tag not in VOID and len(self.open) < MAX_DEPTH:
                    self.open.append(node)
                    if tag in FOREIGN:
                        self.foreign = len(self.open) - 1
                return tag not in VOID
        if tag in VOID:
            self.open[-1].children.append(node)
            return False
        self._push(node)
        if tag in FOREIGN and not inside and self.open[-1] is node:
            self.foreign = len(self.open) - 1
        return True

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p":
            if not self._close({"p"}, SCOPE_ENDS | {"button"}):
                if self.open[-1].tag not in TABLE_PARTS:
                    self.open[-1].children.append(Node("p"))
        elif tag in ("html", "body") or tag in VOID:
            return
        elif tag in HEADINGS:
            self._close(HEADINGS, SCOPE_ENDS)
        elif tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
            self._close({tag}, {"table"} if tag != "table" else set())
        elif tag == "li":
            self._close({"li"}, SCOPE_ENDS | {"ul", "ol", "menu", "dir"})
        else:
            self._close({tag}, SCOPE_ENDS if tag in BLOCKS else SCOPE_ENDS | (BLOCKS - {"p"}))


class _Page:
    """Finds where tags end, in one forward pass over the page."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.quotes = {'"': -1, "'": -1}  # the next quote of each kind, as far as it was looked for

    def _closing(self, quote: str, at: int) -> int:
        if self.quotes[quote] < at:
            found = self.html.find(quote, at)
            self.quotes[quote] = found if found >= 0 else len(self.html)
        return self.quotes[quote]

    def tag_end(self, at: int) -> int:
        """Where the > stands that ends the tag around `at`, -1 if there is none. A quote that hides every > up to the end is none."""
        html = self.html
        while at <= self.last:
            here = _MARK.search(html, at).start()
            if html[here] == ">":
                return here
            before = here - 1
            while html[before].isspace():
                before -= 1
            at = here + 1
            if html[before] == "=" and (closing := self._closing(html[here], at)) < self.last:
                at = closing + 1
        return -1


def parse(html: str) -> tuple[Node, Styles]:
    """The tree of a page, and what its style elements say; whatever the input, no error."""
    builder, page, at, size = Builder(), _Page(html), 0, len(html)
    while at < size:
        here = html.find("<", at)
        if here < 0:
            here = size
        if here > at:
            part = html[at:here]
            builder.text(unescape(part) if "&" in part else part)
            at = here
            continue
        if at < page.last and (found := _TAG.match(html, at)) and (end := page.tag_end(found.end())) >= 0:
            tag, raw = found[2].lower(), html[found.end() : end]
            at = end + 1
            if found[1]:
                builder.end(tag)
                continue
            holds = builder.start(tag, raw)
            if (tag in RAW or tag in ESCAPABLE_RAW) and holds:
                stop = None if tag == "plaintext" else _RAW_END[tag].search(html, at)
                end = stop.start() if stop else size
                content = html[at:end]
                if tag == "style":
                    builder.sheets.append(content)
                if builder.open[-1].tag == tag:
                    builder.open[-1].children.append(unescape(content) if tag in ESCAPABLE_RAW else content)
                    builder.open.pop()
                if stop:
                    end = html.find(">", end)
                    at = end + 1 if end >= 0 else size
                else:
                    at = size
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = end + 3 if end >= 0 else size
        elif html.startswith(("<!", "<?", "</"), at):
            end = html.find(">", at)
            at = end + 1 if end >= 0 else size
        else:
            builder.text("<")
            at += 1
    return builder.root, Styles(builder.sheets)


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Renderer:
    """Writes a tree as lines of text."""

    def __init__(self, styles: Styles, concealed: bool = False):
        self.styles, self.concealed = styles, concealed
        self.lines: list[str] = []
        self.line: list[str] = []
        self.spaced, self.margin = True, 0
        self.indent, self.marker = "", ""

    def hidden(self, node: Node) -> bool:
        """Whether nothing of an element shows; else `concealed` holds for it from now on."""
        a = node.attributes
        if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
            return True
        if not a and not self.styles.rules:
            return False
        found = self.styles.of(node)
        if found.get("display", "none" if "hidden" in a else "") == "none":
            return True
        if "visibility" in found and found["visibility"] not in ("inherit", "unset"):
            self.concealed = found["visibility"] in ("hidden", "collapse")
        return False

    def flush(self) -> None:
        line = "".join(self.line).rstrip(" ")
        self.line, self.spaced = [], True
        if not line:
            return
        if self.lines and self.margin > 1:
            self.lines.append("")
        lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent
        self.lines.append(lead + line)
        self.marker, self.margin = "", 0

    def gap(self, size: int) -> None:
        self.flush()
        self.margin = max(self.margin, size)

    def write(self, text: str) -> None:
        if self.concealed:
            return
        text = _SPACE.sub(" ", text)
        if self.spaced and text.startswith(" "):
            text = text[1:]
        if text:
            self.line.append(text)
            self.spaced = text.endswith(" ")

    def write_as_is(self, text: str) -> None:
        if self.concealed:
            return
        rows = text.replace("\r\n", "\n").split("\n")
        for i, row in enumerate(rows):
            if i:
                empty = not "".join(self.line).strip()
                self.flush()
                if empty and self.lines:
                    self.lines.append("")
            if row:
                self.line.append(row)
                self.spaced = False

    def node(self, node: Node, as_is: bool = False) -> None:
        concealed = self.concealed
        if not self.hidden(node):
            self.shown(node, as_is)
        self.concealed = concealed

    def shown(self, node: Node, as_is: bool) -> None:
        tag = node.tag
        if tag == "svg":
            self.drawing(node)
        elif tag == "br":
            blank = not self.line
            self.flush()
            if blank and self.lines:
                self.margin = max(self.margin, 2)
        elif tag == "table":
            self.table(node)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.list(node)
        elif tag == "input":
            if node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                self.write(" " + unescape(node.attributes.get("value", "")) + " ")
        elif tag == "dd":
            self.gap(1)
            self.indented(node, "  ", "", as_is)
        elif tag == "blockquote":
            self.gap(2)
            self.indented(node, "  ", "", as_is)
            self.gap(2)
        elif tag in BLOCKS:
            size = 2 if tag in MARGINS else 1
            self.gap(size)
            preformatted = tag in ("pre", "listing", "plaintext", "xmp")
            if preformatted and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
            self.children(node, as_is or preformatted)
            self.gap(size)
        else:
            self.children(node, as_is or tag == "textarea")

    def children(self, node: Node, as_is: bool = False) -> None:
        for child in node.children:
            if not isinstance(child, str):
                self.node(child, as_is)
            elif as_is:
                self.write_as_is(child)
            else:
                self.write(child)

    def drawing(self, node: Node) -> None:
        """Text elements of an SVG, apart from each other."""
        for child in node.children:
            if isinstance(child, str) or child.tag in FOREIGN_HIDDEN:
                continue
            concealed = self.concealed
            if child.attributes.get("display") != "none" and not self.hidden(child):
                self.concealed |= child.attributes.get("visibility") in ("hidden", "collapse")
                if child.tag in ("text", "foreignobject"):
                    self.write(" ")
                    self.children(child)
                    self.write(" ")
                else:
                    self.drawing(child)
            self.concealed = concealed

    def indented(self, node: Node, by: str, marker: str, as_is: bool = False) -> None:
        held = self.indent, self.marker
        self.indent, self.marker = self.indent + by, marker
        self.children(node, as_is)
        self.flush()
        if self.marker:  # an item without text
            self.marker = held[1]
        self.indent = held[0]

    def list(self, node: Node) -> None:
        size = 1 if self.indent else 2
        self.gap(size)
        start = node.attributes.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str):
                self.write(child)
                continue
            if child.tag != "li":
                self.node(child)
                continue
            concealed = self.concealed
            if not self.hidden(child):
                marker = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                self.gap(1)
                self.indented(child, " " * len(marker), marker if not self.concealed else "")
            self.concealed = concealed
        self.gap(size)

    def rows(self, node: Node, out: list[tuple[Node, bool]]) -> None:
        """The rows of a table that show, with whether they are concealed; what else stands there is written."""
        concealed = self.concealed
        for child in node.children:
            if isinstance(child, str) or child.tag in ("colgroup", "col"):
                continue
            if child.tag in ("tr", "tbody", "thead", "tfoot"):
                if not self.hidden(child):
                    if child.tag == "tr":
                        out.append((child, self.concealed))
                    else:
                        self.rows(child, out)
            else:
                self.node(child)
                self.gap(1)
            self.concealed = concealed

    def table(self, node: Node) -> None:
        rows: list[tuple[Node, bool]] = []
        self.gap(2)
        self.rows(node, rows)
        grid: list[list[tuple[int, list[str]]]] = []  # (column, lines)
        taken: list[tuple[int, int, int]] = []  # (first column, end, row from which it is free), of cells above
        widths: dict[int, int] = {}
        concealed = self.concealed
        for number, (row, dim) in enumerate(rows):
            cells, column, fresh, k = [], 0, [], 0
            for cell in row.children:
                if isinstance(cell, str):
                    continue
                self.concealed = dim
                if cell.tag not in ("td", "th"):
                    self.node(cell)
                    self.gap(1)
                    continue
                if self.hidden(cell):
                    continue
                while k < len(taken) and taken[k][0] <= column:
                    column = max(column, taken[k][1])
                    k += 1
                inner = Renderer(self.styles, self.concealed)
                inner.children(cell)
                inner.flush()
                across, down = (max(1, min(MAX_SPAN, int(x))) if (x := cell.attributes.get(n, "1")).isdecimal() and x.isascii() and len(x) < 10 else 1 for n in ("colspan", "rowspan"))
                cells.append((column, inner.lines))
                if across == 1:
                    widths[column] = max([widths.get(column, 0), *map(width, inner.lines)])
                if down > 1:
                    fresh.append((column, column + across, number + down))
                column += across
            if taken or fresh:
                taken = sorted([x for x in taken if x[2] > number + 1] + fresh)
            grid.append(cells)
        self.concealed = concealed
        wide = sorted(c for c, n in widths.items() if n)
        before = [0]
        for column in wide:
            before.append(before[-1] + widths[column] + 2)
        start = lambda column: before[bisect_left(wide, column)]
        lines = [[(c, cell[k]) for c, cell in cells if k < len(cell) and cell[k]] for cells in grid for k in range(max([len(cell) for _, cell in cells], default=0))]
        text = sum(len(x) - x.count(" ") for line in lines for _, x in line)
        aligned = sum(start(line[-1][0]) for line in lines if line) <= PAD_LINE * len(lines) + PAD_TEXT * text
        for line in lines:
            out, filled = "", 0
            for column, part in line:
                lead = max(start(column) - filled if aligned else 0, 2 if out else 0)
                out += " " * lead + part
                filled += lead + width(part)
            self.line = [out]
            self.flush()
        self.gap(2)


def render(html: str) -> str:
    """All visible text of a page, laid out in lines."""
    root, styles = parse(html)
    renderer = Renderer(styles)
    if not renderer.hidden(root):
        renderer.children(root)
    renderer.flush()
    return "\n".join(renderer.lines)


@tidy
def _extract_batches(batches, html: str, keep: list[str]):
    for batch in batches:
        for part, texts in slices(batch, html):
            found = [render(t) for t in texts.to_pylist()]
            arrays = [*(part.column(c) for c in keep), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "n_chars"])


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns `keep`, `text` and `n_chars` of every page.

    A null, empty or wholly hidden page has an empty text. Any input is taken, of any length: unclosed
    and misnested tags follow the implied-tag rules, a < without a tag is text, nesting beyond
    MAX_DEPTH is flattened, a cell spans MAX_SPAN columns or rows at most. A table whose alignment
    would take more than PAD_LINE spaces a line and PAD_TEXT a letter is written with two spaces
    between its cells, so that a text's length stays in proportion to its page's. Rows are
    independent; repeated rows and null keys are kept; other columns are left out, whatever their names.
    """
    bounded_batches(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInArrow(partial(_extract_batches, html=html, keep=list(keep)), f"{schema}, text string, n_chars long")
