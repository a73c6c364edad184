"""Visible text of web pages, laid out as a browser would.

A tree builder keeps the stack of open elements, closes what HTML lets authors leave open and opens
what it implies.  Each element is rendered when it closes: blocks on lines of their own with blank
lines where browsers leave a margin, list items behind their marker, preformatted text as it is,
and table cells in aligned columns.  Elements that a browser would not show give no text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import with_columns

# The element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("head title script style template noscript iframe object audio video canvas datalist noframes noembed".split())
#: Within svg and math, what is not drawn; head's own elements; what ends svg by standing in it.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
OF_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = ("svg", "math")
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption textarea xmp plaintext listing".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
ROWS = frozenset(("tbody", "thead", "tfoot"))
#: Elements whose content holds no tags; in the last two it holds character references.
RAW = frozenset("script style xmp iframe noembed noframes plaintext textarea title".split())
CODED = frozenset(("textarea", "title"))
PRE = frozenset(("pre", "textarea", "xmp", "plaintext", "listing"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What opening an element closes, and the elements past which it does not look.
CLOSES = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("td", "th", "tr")), frozenset(("table",))),
    "tbody": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "thead": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))),
}
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption dt dd li option optgroup legend summary".split()) | frozenset(("li", "dt", "dd"))
SCOPE = frozenset(("table", "td", "th", "caption", "html", "button"))
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Elements that may be open in one another; deeper ones only say whether their text shows.
DEEPEST = 512
#: Columns of a table; longest cell that widens its column; items and quotes that indent.
COLUMNS, WIDEST, INDENTS = 1000, 120, 20
#: Padding of a table, as a multiple of its own markup without tables in it; one that needs more stands unaligned.
PADDING = 8

TAG = re.compile(r"[^ \t\n\f/>]+")
BETWEEN = re.compile(r"[ \t\n\f/]*")
NAME = re.compile(r"=?[^ \t\n\f/>=]*")
EQUALS = re.compile(r"[ \t\n\f]*=[ \t\n\f]*")
COMMENT_END = re.compile(r"--!?>")
BARE = re.compile(r"[^ \t\n\f>]*")
LONG = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f/>])", re.IGNORECASE) for tag in RAW}


def decoded(text: str) -> str:
    """Character references replaced; numbers of any length are read once."""
    if "&" not in text:
        return text

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'x' if m[2] else ''}{digits};"

    return unescape(LONG.sub(short, text) if "&#" in text else text)


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag, the first of equal names, and the place past its ``>``, -1 if the page ends before."""
    found: dict[str, str] = {}
    while True:
        at = BETWEEN.match(page, at).end()
        if at >= len(page):
            return found, -1
        if page[at] == ">":
            return found, at + 1
        name = NAME.match(page, at)
        value, at = "", name.end()
        if m := EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                m = BARE.match(page, at)
                value, at = m[0], m.end()
        found.setdefault(name[0].lower(), value)


def shown_by(style: str) -> tuple[str | None, str | None]:
    """The display and visibility that style declarations set; the last of a name, or the last important one."""
    found: dict[str, tuple[bool, str]] = {}
    if ":" in style:
        for part in STYLE_COMMENT.sub(" ", style).lower().split(";"):
            name, _, value = part.partition(":")
            name, (value, mark, _) = name.strip(), value.partition("!")
            if name in ("display", "visibility") and (mark or not found.get(name, (False,))[0]):
                found[name] = bool(mark), value.strip()
    return found.get("display", (0, None))[1], found.get("visibility", (0, None))[1]


def whole_number(text: str | None, default: int, most: int) -> int:
    """Leading digits as a number, ``most`` at most."""
    m = re.match(r"[ \t\n\f]*([0-9]+)", text or "")
    return default if not m else most if len(digits := m[1].lstrip("0")) > 9 else min(most, int(digits or "0"))


class Node:
    """An open element; a block also has its finished lines and the line being written."""

    __slots__ = ("tag", "lines", "line", "gap", "gone", "unseen", "pre", "item", "rows", "attrs", "start", "within")

    def __init__(self, tag: str, attrs: dict, gone: bool, unseen: bool, pre: bool, start: int):
        self.tag, self.attrs, self.gone, self.unseen, self.pre = tag, attrs, gone, unseen, pre
        self.start, self.within = start, 0  # place in the page; characters of tables inside
        if tag in BLOCK or tag == "#root":
            self.lines: list[str] = []
            self.line: list[str] = []
            self.gap = 0  # blank lines wanted before the next line
            self.item = 0
            self.rows: list[list[Cell]] = []


#: A cell's lines, and the columns and rows that it spans.
Cell = tuple[list[str], int, int]


class TreeBuilder:
    """Feeds a page to the stack of open elements and renders elements as they close.

    The page is read once, in steps that never go back, so time grows with its length.
    """

    def __init__(self):
        self.stack = [Node("#root", {}, False, False, False, 0)]
        self.flow = [self.stack[0]]  # the blocks among them
        self.open: dict[str, int] = {}  # how many of each tag are on the stack
        self.deep: list[tuple[str, bool, bool, bool]] = []  # past DEEPEST: tag, whether it and its text are gone, unseen
        self.deep_open: dict[str, int] = {}
        self.at = 0

    # -- tokens -------------------------------------------------------------------------------

    def feed(self, page: str) -> None:
        if "\r" in page:
            page = page.replace("\r\n", "\n").replace("\r", "\n")
        at = 0
        while 0 <= at < len(page):
            start = page.find("<", at)
            self.at = start if start >= 0 else len(page)
            if start != at:
                self.handle_data(page[at : start if start >= 0 else len(page)])
            if start < 0:
                return
            at = self._markup(page, start)
        self.at = len(page)

    def _markup(self, page: str, start: int) -> int:
        """Handle what begins with ``<`` at ``start``; the place past it, -1 if the page ends inside."""
        kind = page[start + 1 : start + 2]
        closing = kind == "/"
        first = page[start + 2 : start + 3] if closing else kind
        if first.isascii() and first.isalpha():
            m = TAG.match(page, start + 1 + closing)
            tag, at, attrs = m[0].lower(), m.end(), {}
            if page.startswith(">", at):
                at += 1
            else:
                attrs, at = attributes(page, at)
            if at < 0:
                return at
            if closing:
                self.handle_endtag(tag)
                return at
            self.handle_starttag(tag, attrs, page[at - 2] == "/")
            if tag in RAW:
                end = RAW_END[tag].search(page, at) if tag != "plaintext" else None
                self.handle_data(page[at : end.start() if end else len(page)], tag in CODED)
                return end.start() if end else -1
            return at
        if page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                return page.find(">", start) + 1
            m = COMMENT_END.search(page, start + 4)
            return m.end() if m else -1
        if kind in ("!", "?") or closing and first:
            end = page.find(">", start)
            return end + 1 if end >= 0 else -1
        self.handle_data("<")
        return start + 1

    # -- tree ---------------------------------------------------------------------------------

    def _inside(self, *tags: str) -> bool:
        return any(self.open.get(t) or self.deep_open.get(t) for t in tags)

    def handle_starttag(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if not self.deep:
            if self.stack[-1].tag == "head" and tag not in OF_HEAD:
                self._pop()
            if tag in BREAKOUT and self.open.get("svg") and not self._inside("foreignobject", "desc", "math"):
                self._close_until(frozenset(("svg",)), frozenset(), outermost=True)
            if tag in CLOSES:
                self._close_until(*CLOSES[tag], outermost=True)
            if tag in ENDS_P:
                self._close_until(frozenset(("p",)), SCOPE)
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self._pop()
            if tag in ("td", "th") and self.stack[-1].tag in ROWS | {"table"}:
                self._push("tr", {})
        if tag == "br":
            self._end_line(True)
        elif tag == "hr":
            self._end_line()
            self.flow[-1].gap = max(self.flow[-1].gap, 1)
        elif tag == "input":
            kind = (attrs.get("type") or "text").lower()
            if kind in ("submit", "reset", "button", "text", "search", "email", "url", "tel", "number"):
                self.handle_data(f" {attrs.get('value') or ''} ")
        if tag not in VOID and not (closed and tag not in RAW and (tag in FOREIGN or self._inside(*FOREIGN))):
            self._push(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.deep:
            if self.deep_open.get(tag):
                while self._leave_deep() != tag:
                    pass
                return
            if any(self.deep_open.get(x) for x in ("table", "td", "th", "caption")):
                return
        if tag == "br":
            self._end_line(True)
        elif tag == "p" and not self.open.get("p"):
            self._push("p", {})
            self._pop()
        elif tag not in VOID:
            limit = frozenset(("table",)) if tag in BLOCK and tag != "table" else frozenset() if tag in BLOCK else frozenset(("td", "th", "table"))
            self._close_until(frozenset((tag,)), limit)

    def _leave_deep(self) -> str:
        tag = self.deep.pop()[0]
        self.deep_open[tag] -= 1
        if tag in BLOCK:
            self._end_line()
        return tag

    def _close_until(self, tags: frozenset, limit: frozenset, outermost: bool = False) -> None:
        """Close the nearest (or outermost) element in ``tags`` this side of ``limit``, and all inside it."""
        if not any(self.open.get(t) for t in tags):
            return
        found = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                found = i
                if not outermost:
                    break
            elif self.stack[i].tag in limit:
                break
        while found and len(self.stack) > found:
            self._pop()

    def _push(self, tag: str, attrs: dict) -> None:
        above = self.stack[-1]
        inside, gone, text_gone, unseen = self.deep[-1] if self.deep else (above.tag, above.gone, above.gone or above.tag == "details" and "open" not in above.attrs, above.unseen)
        display, visibility = shown_by(attrs.get("style") or "")
        if not (tag == "summary" and inside == "details"):
            gone = text_gone
        gone = gone or tag in UNSHOWN or display == "none" or "hidden" in attrs and display is None or tag == "dialog" and "open" not in attrs and display is None or tag in UNDRAWN and self._inside(*FOREIGN)
        # Visibility is handed down, and shows again where an element says so; what is gone stays gone.
        unseen = visibility in ("hidden", "collapse") if visibility in ("hidden", "collapse", "visible", "initial") else unseen
        if tag in BLOCK:
            self._end_line()
        if len(self.stack) >= DEEPEST:
            self.deep.append((tag, gone, gone or tag == "details" and "open" not in attrs, unseen))
            self.deep_open[tag] = self.deep_open.get(tag, 0) + 1
            return
        node = Node(tag, attrs, gone, unseen, above.pre or tag in PRE, self.at)
        if tag in BLOCK:
            self.flow.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    # -- text ---------------------------------------------------------------------------------

    def handle_data(self, data: str, coded: bool = True) -> None:
        if self.stack[-1].tag == "head" and not self.deep and data.strip(" \t\n\r\f"):
            self._pop()  # text of the body, whose tag may be left out
        node, block = self.stack[-1], self.flow[-1]
        if self.deep[-1][2] or self.deep[-1][3] if self.deep else node.gone or node.unseen or node.tag == "details" and "open" not in node.attrs:
            return
        if node.tag in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") and not data.strip():
            return
        if coded:
            data = decoded(data)
        if node.pre:
            first, *rest = data.split("\n")
            block.line.append(first)
            for x in rest:
                self._end_line(True)
                block.line.append(x)
        else:
            block.line.append(SPACE.sub(" ", data))

    def _end_line(self, forced: bool = False) -> None:
        block = self.flow[-1]
        text = "".join(block.line)
        block.line.clear()
        text = text.rstrip() if block.pre else SPACE.sub(" ", text).strip(" ")
        if text or forced:
            self._add(block, [text], 0, 0)

    def _add(self, block: Node, lines: list[str], before: int, after: int) -> None:
        gap = max(block.gap, before)
        if block.lines and gap:
            block.lines += [""] * gap
        block.lines += lines
        block.gap = after

    # -- rendering ----------------------------------------------------------------------------

    def _pop(self) -> None:
        while self.deep:
            self._leave_deep()
        node = self.stack[-1]
        tag = node.tag
        if tag in BLOCK:
            self._end_line()
            self.flow.pop()
        self.stack.pop()
        self.open[tag] -= 1
        if tag not in BLOCK:
            return
        lines, above = _trimmed(node.lines), self.flow[-1]
        if tag == "tr":
            self._add_row(node, lines)
            return
        if tag in ("td", "th") and self.open.get("tr"):
            row = next(n for n in reversed(self.flow) if n.tag == "tr")
            wide, tall = max(1, whole_number(node.attrs.get("colspan"), 1, COLUMNS)), whole_number(node.attrs.get("rowspan"), 1, 65534)
            row.rows.append((lines if not node.gone else [], wide, tall or 65534))
            return
        if tag in ROWS:
            rows = [[(x, wide, min(tall, len(node.rows) - i)) for x, wide, tall in row] for i, row in enumerate(node.rows)]  # no cell reaches past its group
            box = next((n for n in reversed(self.flow) if n.tag in ROWS or n.tag == "table"), None)
            if box is not None:
                box.rows += rows
            else:  # a row group outside a table: its rows are lines
                lines += self._aligned(rows, self.at - node.start - node.within)
        if tag == "table":
            lines += self._aligned(node.rows, self.at - node.start - node.within)
            for box in reversed(self.flow):
                if box.tag == "table" or box.tag in ROWS and not self.open.get("table"):
                    box.within += self.at - node.start
                    break
        if not lines:
            return
        indents = self.open.get("li", 0) + self.open.get("blockquote", 0) + self.open.get("dd", 0) < INDENTS
        if tag == "li":
            box = next((n for n in reversed(self.flow) if n.tag in LISTS), None)
            mark = "- "
            if box is not None and box.tag == "ol":
                start = str(box.attrs.get("start") or "1")
                box.item += 1
                mark = f"{box.item - 1 + (int(start) if re.fullmatch(r'-?[0-9]{1,9}', start) else 1)}. "
            if indents:
                lines = [(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)]
            else:
                lines[0] = mark + lines[0]
        elif tag in ("blockquote", "dd") and indents:
            lines = ["  " + x if x else x for x in lines]
        spaced = int(tag in SPACED and not (tag in LISTS and any(self.open.get(x) for x in LISTS)))
        self._add(above, lines, spaced, spaced)

    def _add_row(self, node: Node, loose: list[str]) -> None:
        table = next((n for n in reversed(self.flow) if n.tag in ROWS or n.tag == "table"), None)
        cells = node.rows + ([(loose, 1, 1)] if loose else [])
        if table is not None:
            table.rows.append(cells)
            return
        for lines, _, _ in cells:  # a row outside a table: its cells are lines
            if lines:
                self._add(self.flow[-1], lines, 0, 0)

    def _aligned(self, rows: list[list[Cell]], own: int) -> list[str]:
        """Rows of cells as lines, columns two spaces apart.

        A column is as wide as its longest line of up to WIDEST characters; longer lines push what
        follows to the right.  If that takes more than PADDING times the ``own`` characters of the
        table's markup, its cells stand two spaces apart and are not aligned, whatever other tables do.
        """
        placed, width = _placed(rows)
        offset, at = [], 0
        for i in range(1 + max((c for row in placed for c, _ in row), default=-1)):
            offset.append(at)
            at += width.get(i, -2) + 2
        rows_of_gaps, padding = [], 0
        for row in placed:
            lines: list[list[tuple[int, str]]] = [[] for _ in range(max((len(c) for _, c in row), default=0))]
            ends = [0] * len(lines)
            for column, cell in row:
                for k, text in enumerate(cell):
                    if text:
                        gap = max(offset[column] - ends[k], 2 if ends[k] else 0)
                        padding += gap
                        lines[k].append((gap, text))
                        ends[k] += gap + len(text)
            rows_of_gaps += lines
        if padding > PADDING * own:
            return ["  ".join(text for _, text in x).rstrip() for x in rows_of_gaps]
        return ["".join(" " * gap + text for gap, text in x).rstrip() for x in rows_of_gaps]

    def text(self) -> str:
        while len(self.stack) > 1:
            self._pop()
        self._end_line()
        return "\n".join(_trimmed(self.stack[0].lines)).strip("\n")


def _trimmed(lines: list[str]) -> list[str]:
    """Lines without empty ones at either end."""
    a, b = 0, len(lines)
    while a < b and not lines[a]:
        a += 1
    while b > a and not lines[b - 1]:
        b -= 1
    return lines if b - a == len(lines) else lines[a:b]


def _placed(rows: list[list[Cell]]) -> tuple[list[list[tuple[int, list[str]]]], dict[int, int]]:
    """Each row's cells with their columns, past those that cells of rows above span; the columns' widths.

    Cells past COLUMNS share the last column.
    """
    until: dict[int, int] = {}
    spanned = 0
    placed, width = [], {}
    for r, row in enumerate(rows):
        column, out = 0, []
        for lines, wide, tall in row:
            while spanned > r and column < COLUMNS and until.get(column, 0) > r:
                column += 1
            if lines:
                out.append((column, lines))
                longest = max((len(x) for x in lines if len(x) <= WIDEST), default=0)
                if longest > width.get(column, 0):
                    width[column] = longest
            end = min(COLUMNS, column + wide)
            if tall > 1:
                spanned = max(spanned, r + tall)
                until.update(dict.fromkeys(range(column, end), r + tall))
            column = end
        placed.append(out)
    return placed, width


def render(page: str | None) -> str:
    """Visible text of one page; empty for null, and for pages that show nothing."""
    builder = TreeBuilder()
    builder.feed(page or "")
    return builder.text()


def visible_text(pages: DataFrame, ids: list[str], html: str = "html") -> DataFrame:
    """``ids``, ``text`` as laid out, and ``n_lines``.

    Null and empty pages give the empty text and 0 lines; malformed ones what their tree shows, a tag
    that the page ends in nothing.  Pages of any length and depth take time in proportion to their
    length: past ``DEEPEST`` open elements, further ones lay out as text of the innermost, shown or
    hidden as they say; past ``INDENTS`` items and quotes, further ones are not indented; a table stands
    unaligned if its padding passes ``PADDING`` times its own markup.  No text is dropped for these.
    Rows, repeated ones too, stay one for one; columns beyond ``ids`` and ``html`` are not read,
    and ``ids`` must not be named like a result.
    """

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        texts = [render(x) for x in part.column("html_of").to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())]

    return with_columns(pages.select(*ids, F.col(html).alias("html_of")), "html_of", compute, [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())])
