"""Visible text of HTML pages, laid out: blocks, lists, preformatted text and aligned tables.

A tokenizer feeds a tree builder that supplies the tags which HTML lets authors leave out; a renderer walks the tree,
leaves out what a browser doesn't show, and writes blocks with their spacing. Both work with explicit
stacks, so that deep nesting is no matter. Each page is one row; Spark deals the pages.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets of HTML's element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("rp head title script style template noscript iframe noembed noframes canvas audio video datalist area annotation annotation-xml mphantom".split())
#: Within svg, what is drawn only by reference or not at all, and what holds text that is drawn.
UNDRAWN, DRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc".split()), frozenset(["text", "foreignobject"])
PRE = frozenset(["pre", "xmp", "plaintext"])
SPACED = PRE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav option optgroup search section summary tbody td tfoot th thead tr".split())
#: A start tag closes these open elements, looked for up to the elements behind them.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: An end tag doesn't reach over these, unless it is their own.
SCOPE = frozenset("table td th caption html template button object foreignobject".split())

#: Parts of a table reach over its cells, not over the table.
TABLE_PARTS, TABLE_SCOPE = frozenset("table caption colgroup thead tbody tfoot tr td th".split()), frozenset(["table"])

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?:>|[^a-zA-Z>][^>]*>?)|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))[^>\"']*)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/=][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s]+)))?")
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*(-?\d{1,12})")

#: Fixed: the largest spans of a cell that HTML knows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A longer cell doesn't widen its column, one gap is padded so far at most, and indentation stops there, so that a page's text is no longer than a multiple of its source. Text is never cut.
WIDEST, MOST_PADDING, DEEPEST = 60, 1000, 40
#: Columns up to which a cell's rows below it are remembered.
TRACKED = 20_000


class Node:
    """An element: its name, attributes as written, and children, which are nodes or strings."""

    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = "") -> None:
        self.name, self.attributes, self.children = name, attributes, []


def attributes_of(written: str) -> dict[str, str]:
    """Names, lower-cased, and values of the attributes of a start tag; of repeated names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(written):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _shown(name: str, written: str) -> tuple[bool, bool | None]:
    """Whether the element is laid out, and what its attributes say of visibility: True, False, or None for that of its parent.

    The style attribute's display counts before an attribute named hidden.
    """
    if name == "dialog" and "open" not in attributes_of(written):
        return False, None
    if not _MAY_HIDE.search(written):
        return True, None
    attributes = attributes_of(written)
    style: dict[str, tuple[str, bool]] = {}
    for declaration in _COMMENT.sub(" ", attributes.get("style", "")).lower().split(";"):
        key, _, value = declaration.partition(":")
        key, (value, mark, _) = key.strip(), value.partition("!")
        if mark or not style.get(key, ("", False))[1]:
            style[key] = (value.strip(), bool(mark))
    display, visibility = (style.get(k, ("", False))[0] for k in ("display", "visibility"))
    laid = display != "none" if display else "hidden" not in attributes
    return laid, {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(visibility)


_IN_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)


def _script_end(source: str, at: int) -> tuple[int, int]:
    """Where a script's text ends and where its end tag does; within a comment, a script in it has an end tag of its own."""
    comment = inner = False
    for m in _IN_SCRIPT.finditer(source, at):
        if m[0] == "<!--":
            comment = True
        elif m[0] == "-->":
            comment = inner = False
        elif not m[1]:
            inner = comment
        elif inner:
            inner = False
        else:
            end = source.find(">", m.end())
            return m.start(), end + 1 if end >= 0 else len(source)
    return len(source), len(source)


def parse(source: str) -> Node:
    """The page's tree. What isn't a tag is text; an unclosed tag or comment at the end is left out."""
    root = Node("html")
    stack, at, n = [root], 0, len(source)
    opened: dict[str, list[int]] = {}  # where on the stack the open elements of each name are, so that no tag has to look through it

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().name].pop()

    def last(names) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    def close(names: frozenset[str], stop: frozenset[str]) -> bool:
        """Close the last open element of ``names``, if it is behind all others of ``stop``."""
        found = last(names)
        if found and found > last(stop - names):
            pop_to(found)
            return True
        return False

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif not (opened.get(name) and close(frozenset([name]), TABLE_SCOPE if name in TABLE_PARTS else SCOPE)) and name == "p":
                stack[-1].children.append(Node("p"))  # a stray one is an empty paragraph
        elif m[2]:
            name, attributes = m[2].lower(), m[3]
            if name in ("html", "body") and opened.get("body"):
                continue
            if name in BLOCK and name not in ("option", "optgroup") and opened.get("p"):
                close(frozenset(["p"]), SCOPE)
            if name in CLOSES:
                close(*CLOSES[name])
            if opened.get("head") and name not in UNSEEN and name not in VOID:
                close(frozenset(["head"]), frozenset())
            node = Node(name, attributes)
            stack[-1].children.append(node)
            if name in RAW and not (attributes.endswith("/") and (opened.get("svg") or opened.get("math"))):
                if name == "script":
                    until, after = _script_end(source, at)
                else:
                    end = None if name == "plaintext" else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    until, after = (end.start(), end.end()) if end else (n, n)
                inside = source[at:until]
                if name == "textarea":
                    node.children.append(html.unescape(inside))
                elif name in PRE:
                    node.children.append(inside)
                at = after
            elif name not in VOID and not attributes.endswith("/"):
                opened.setdefault(name, []).append(len(stack))
                stack.append(node)
    return root


class _Out:
    """Lines of a block, with pending space and indentation."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a space is due before the next word
        self.blank = False  # an empty line is due before the next text
        self.indent: list[str] = []
        self.mark = ""  # a list item's mark, due before its first text

    def put(self, text: str, keep: bool = False) -> None:
        if not keep:
            words = _SPACES.sub(" ", text)
            self.gap |= words[:1] == " "
            body = words.strip(" ")
            if body:
                self._begin()
                self.line.append((" " if self.gap and self.line[1:] else "") + body)
                self.gap = words[-1] == " "
            return
        for i, piece in enumerate(text.split("\n")):
            if i:
                self.end(force=True)
            if piece:
                self._begin()
                self.line.append(piece)

    def _begin(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            indent = "".join(self.indent[:DEEPEST])[:DEEPEST]
            self.line.append(indent[: max(0, len(indent) - len(self.mark))] + self.mark if self.mark else indent)
            self.mark = ""

    def end(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
        elif force and self.lines:
            self.lines.append("")
        self.line, self.gap = [], False

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _number(node: Node, attribute: str) -> int | None:
    m = _NUMBER.match(attributes_of(node.attributes).get(attribute, "")) if node.attributes else None
    return int(m[1]) if m else None


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """Rows of (cell, columns, rows it spans; 0 rows: all that follow) as rows of (first column, columns, cell); cells from rows above keep their columns."""
    out: list[list[tuple[int, int, str]]] = []
    below, until = np.zeros(0, np.int32), 0  # for each column, the first row that no cell from above reaches; the largest of them
    for nth, row in enumerate(rows):
        line, at = [], 0
        free = np.flatnonzero(below <= nth) if nth < until else None
        for cell, columns, deep in row:
            if free is not None:
                k = np.searchsorted(free, at)
                at = int(free[k]) if k < len(free) else max(at, len(below))
            line.append((at, columns, cell))
            at += columns
        for (a, columns, _), (_, _, deep) in zip(line, row, strict=True):
            if deep != 1 and a < TRACKED:
                end, last = min(a + columns, TRACKED), min(nth + (deep or MOST_ROWS), 2**31 - 1)
                if end > len(below):
                    below = np.concatenate([below, np.zeros(max(end, 2 * len(below)) - len(below), np.int32)])
                np.maximum(below[a:end], last, out=below[a:end])
                until = max(until, last)
        out.append(line)
    return out


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (cell, columns, rows it spans) with columns aligned, two spaces apart.

    A column is as wide as its widest cell of up to WIDEST characters; longer cells are written whole and push the rest of their line on. A cell begins at its column also
    where there is none to its left, up to a gap of MOST_PADDING.
    """
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for at, columns, cell in row:
            if columns == 1 and len(cell) <= WIDEST:
                widths[at] = max(widths.get(at, 0), len(cell))
    known = sorted(c for c in widths if widths[c])
    upto = [0]
    for c in known:
        upto.append(upto[-1] + widths[c] + 2)

    def between(a: int, b: int) -> int:
        return upto[bisect_left(known, b)] - upto[bisect_left(known, a)]

    out = []
    for row in placed:
        line, end = [], 0
        for at, columns, cell in row:
            if not cell and columns > 1:
                continue
            if at > end:  # columns without a cell here
                line.append(" " * min(between(end, at), MOST_PADDING))
            line.append(cell.ljust(min(max(between(at, at + columns) - 2, 0), MOST_PADDING)) + "  ")
            end = at + columns
        out.append("".join(line).rstrip(" "))
    return [x for x in out if x]


def render(root: Node) -> str:
    """The tree's visible text."""
    out = _Out()
    # what is open of tables: (output outside, rows) and of lists: [kind, next number]
    tables: list[tuple[_Out, list]] = []
    lists: list[list] = []
    pre = 0
    drawn: list[bool] = []  # within svg, whether text is drawn
    seen: list[tuple[Node, bool]] = []  # elements that say whether their text is visible
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if (not drawn or drawn[-1]) and (not seen or seen[-1][1]):
                out.put(node, keep=pre > 0)
            continue
        name = node.name
        if leaving:
            if seen and seen[-1][0] is node:
                seen.pop()
            if name in ("ul", "ol"):
                lists.pop()
            elif name == "li":
                out.end()
                out.mark = ""
                out.indent.pop()
            elif name in ("blockquote", "dd"):
                out.end()
                out.indent.pop()
            elif name in PRE:
                pre -= 1
            elif name == "svg" or name in DRAWN and drawn:
                drawn.pop()
                out.gap = True
            elif name in ("td", "th") and tables:
                cell = " ".join(x.strip() for x in out.text().split("\n") if x.strip())
                columns, deep = _number(node, "colspan"), _number(node, "rowspan")
                columns = min(columns, MOST_COLUMNS) if columns and columns > 0 else 1
                tables[-1][1][-1].append((cell, columns, min(deep, MOST_ROWS) if deep is not None and deep >= 0 else 1))
                out = node.children  # the output that the cell set aside
            elif name == "table" and tables:
                _, rows = tables.pop()
                for line in _table(rows):
                    out.put(line, keep=True)
                    out.end()
            if name in BLOCK:
                out.end()
                out.blank |= name in SPACED and not (name in ("ul", "ol") and lists)
            continue
        laid, visible = _shown(name, node.attributes) if node.attributes or name == "dialog" else (True, None)
        if name in UNSEEN or not laid or name == "input" or drawn and name in UNDRAWN:
            continue
        if name == "br":
            out.end(force=True)
            continue
        if name in BLOCK:
            out.end()
            out.blank |= name in SPACED and not (name in ("ul", "ol") and lists)
        if name == "hr":
            continue
        if visible is not None:
            seen.append((node, visible))
        children = node.children
        if name == "details" and "open" not in attributes_of(node.attributes):
            children = [x for x in children if isinstance(x, Node) and x.name == "summary"][:1]
        if name in ("ul", "ol"):
            start = _number(node, "start") if name == "ol" else None
            lists.append([name, 1 if start is None else start])
        elif name == "li":
            kind = lists[-1] if lists else ["ul", 1]
            given = _number(node, "value") if kind[0] == "ol" else None
            kind[1] = kind[1] if given is None else given
            out.mark = "" if seen and not seen[-1][1] else f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            out.indent.append(" " * len(out.mark))
        elif name in ("blockquote", "dd"):
            out.indent.append("  ")
        elif name in PRE:
            pre += 1
        elif name == "svg" or name in DRAWN and drawn:
            drawn.append(name != "svg")
            out.gap = True
        elif name in ("option", "optgroup") and (label := attributes_of(node.attributes).get("label")):
            children = [label] if name == "option" else [label, Node("br"), *children]
        elif name == "table":
            tables.append((out, []))
        elif name == "tr" and tables:
            tables[-1][1].append([])
        elif name in ("td", "th") and tables:
            if not tables[-1][1]:
                tables[-1][1].append([])
            node.children, out = out, _Out()
        todo.append((node, True))
        todo += [(c, False) for c in reversed(children)]
    return out.text().strip("\n")


def visible_text(source: str) -> str:
    """A page's visible text; see extract()."""
    return render(parse(source))


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(page_id, url, text), one row for each row of ``pages``.

    Null or empty pages give an empty text. Spaces collapse outside pre; paragraphs, headings, lists, tables and quotes
    stand apart by an empty line, other blocks begin a line; list items carry "- " or their number and are indented by
    depth; a table has a line for each row with its columns aligned, row spans included. What padding and indentation an element adds to the page's text is bounded. Options of a select are lines, shown by their label where
    they have one; objects give their fallback, svg the text it draws, math all but its annotations, xmp and plaintext their source.
    Scripts, styles, the head, templates, elements that aren't laid out (display in the style attribute, or the attribute hidden), closed dialogs, all of
    closed details but the summary, what is invisible (visibility in the style attribute, its own or the nearest parent's), rp, inputs, datalists, noscript, and fallback of frames, media and canvas give no text. Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", F.col(html_column).alias("html")).mapInArrow(run, "page_id long, url string, text string")
