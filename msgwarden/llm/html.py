"""Text of HTML pages as a reader sees it: tree building with implied tags, visibility, layout."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Never shown, nor what is in them.
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist object video audio canvas area base col colgroup embed input link meta param source track".split())
#: What a head holds; anything else opens the body.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: Not shown within svg and math, besides HIDDEN.
HIDDEN_IN = {
    "svg": frozenset("defs symbol desc metadata clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: Their elements whose content is HTML again, those on lines of their own, and those whose parts stand apart.
HTML_IN = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
LINES_IN = {"svg": frozenset({"text"}), "math": frozenset({"mtr", "mlabeledtr"})}
APART = frozenset({"mfrac", "mtr", "mlabeledtr"})
#: Blocks with a blank line around them, and blocks without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu pre figure fieldset table hr details xmp".split())
PLAIN_BLOCKS = frozenset(
    "html body div section article aside nav main header footer address form li dt dd legend figcaption summary center dialog"
    " optgroup option tr td th thead tbody tfoot caption search hgroup".split()
)
BLOCKS = SPACED | PLAIN_BLOCKS
#: These end an svg or math that was left open.
ENDS_FOREIGN = BLOCKS | frozenset("b big br code em embed head i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
#: Opening the key ends an open element of the value, unless one of SCOPE[key] lies between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot"},
    "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"}, "body": {"head"}, "caption": {"caption"},
}
LISTS, TABLE = frozenset({"ul", "ol", "menu", "dl"}), frozenset({"table"})
SCOPE = {k: LISTS | TABLE if k in ("li", "dt", "dd") else TABLE if k not in ("option", "optgroup") else frozenset({"select"}) for k in ENDS}
#: A paragraph ends where one of these begins.
ENDS_P = (SPACED | PLAIN_BLOCKS) - {"td", "th", "tr", "option", "optgroup", "html", "body", "caption", "thead", "tbody", "tfoot"}
HOLDS_P = frozenset("td th table li div blockquote button".split())
CELL, OF_TABLE = frozenset({"td", "th", "table"}), frozenset("table tr tbody thead tfoot td th body html".split())
#: Widest column that cells are padded to; wider cells push their row's remainder to the right.
PADDED = 80

# a quote opens a value right after `=` only
_NAME = r"""(?:=[^\s/>=]*+|[^\s/>=]++)"""
_VALUE = r""""[^"]*"|'[^']*'|[^\s"'>][^\s>]*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_NAME}(?:\s*=\s*(?:{_VALUE}|(?=>)))?+)*+)>|<[!?/][^>]*>?|[^<]+|<""", re.S
)
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:\s*=\s*({_VALUE}))?+""")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: str = ""):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], foreign

    def within(self) -> str:
        """What its content is of: svg, math, or "" for HTML."""
        if not self.foreign or self.tag in HTML_IN[self.foreign]:
            return ""
        return "" if self.tag == "annotation-xml" and "html" in self.attrs.get("encoding", "").lower() else self.foreign


def _attributes(source: str) -> tuple[dict[str, str], bool]:
    """The attributes, and whether a slash that is not part of a value ends the tag."""
    found, end = {}, 0
    for match in _ATTRIBUTE.finditer(source):
        name, value = match.groups("")
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
        end = match.end()
    return found, end < len(source) and source[-1] == "/"


def tree(page: str) -> Node:
    """The page's elements, with the tags that may be left out put in.

    Unknown end tags are ignored; the end tag of an inline element never ends a block. Text and what is not `IN_HEAD` end
    the head; an HTML element ends an svg or math that was left open.
    """
    root = Node("html", {})
    open_, within, count = [root], [""], Counter()

    def begin(node: Node, stays: bool = True) -> None:
        open_[-1].children.append(node)
        if stays:
            open_.append(node)
            within.append(node.within())
            count[node.tag] += 1

    def cut(i: int) -> None:
        count.subtract(n.tag for n in open_[i:])
        del open_[i:], within[i:]

    def end(tags, barrier) -> None:
        if any(count[t] for t in tags):
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in tags:
                    return cut(i)
                if open_[i].tag in barrier:
                    return

    at = 0
    while match := _TOKEN.match(page, at):
        if within[-1] and page.startswith("<![CDATA[", at):
            close = page.find("]]>", at)
            open_[-1].children.append(page[at + 9 : close if close >= 0 else len(page)])
            at = close + 3 if close >= 0 else len(page)
            continue
        at = match.end()
        slash, name, attributes = match.groups()
        if name is None:
            text = match[0]
            if text[0] != "<" or text == "<":
                if open_[-1].tag == "head" and text.strip():
                    cut(len(open_) - 1)
                open_[-1].children.append(unescape(text) if "&" in text else text)
            continue
        tag = name.lower()
        if slash:
            if tag == "p" and not count["p"]:
                open_[-1].children.append(Node("p", {}))
            for i in range(len(open_) - 1, 0, -1) if count[tag] else ():
                if open_[i].tag == tag:
                    cut(i)
                    break
                if open_[i].tag in (CELL if tag in BLOCKS or tag == "select" else BLOCKS) and tag not in OF_TABLE:
                    break
            continue
        # a head that comes after other content is ignored, as is a second one
        if tag == "html" or tag == "head" and (len(open_) > 1 or any(isinstance(c, Node) or c.strip() for c in root.children)):
            continue
        if within[-1] and tag in ENDS_FOREIGN:
            i = len(open_)
            while within[i - 1]:
                i -= 1
            cut(i)
        if tag in ENDS_P:
            end({"p"}, HOLDS_P)
        if tag in ENDS:
            end(ENDS[tag], SCOPE[tag])
        if open_[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(open_) - 1)
        if tag in ("tr", "td", "th") and open_[-1].tag == "table":
            begin(Node("tbody", {}))
        if tag in ("td", "th") and open_[-1].tag in ("tbody", "thead", "tfoot"):
            begin(Node("tr", {}))
        attrs, closed = _attributes(attributes) if attributes else ({}, False)
        node = Node(tag, attrs, tag if tag in HTML_IN else within[-1])
        closed = closed and bool(node.foreign)
        begin(node, tag not in RAW and tag not in VOID and not closed)
        if tag in RAW and not closed:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            body = page[at : close.start() if close else len(page)]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = close.end() if close else len(page)
    return root


class Writer:
    """Lines of one flow: white space collapses, blocks begin on new lines, blank lines between them do not add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap = False, 0
        self.indents: list[str] = []
        self.marker = ""

    def text(self, source: str, as_is: bool) -> None:
        if as_is:
            first, *rest = source.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.end_line(True)
                self._put(line)
            return
        words = _SPACE.split(source)
        if not words[0] and len(words) > 1:
            self.space = bool(self.line)
        inner = " ".join(w for w in words if w)
        if inner:
            self._put((" " if self.space and self.line else "") + inner)
            self.space = not words[-1]

    def _put(self, text: str) -> None:
        if text:
            if not self.line and self.gap and self.lines:
                self.lines += [""] * self.gap
            if not self.line:
                self.gap = 0
            self.line.append(text)

    def end_line(self, force: bool = False) -> None:
        text = "".join(self.line).rstrip(" ")
        if self.line or force:
            indent = "".join(self.indents)
            if self.marker and text:
                indent, self.marker = indent[: len(indent) - len(self.marker)] + self.marker, ""
            self.lines.append((indent + text).rstrip())
        self.line, self.space = [], False

    def block(self, blank: int = 0) -> None:
        self.end_line()
        self.gap = max(self.gap, blank)

    def rows(self, lines: list[str]) -> None:
        """Finished lines, as they are."""
        for line in lines:
            self._put(line or " ")
            self.end_line()


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.held: dict[int, int] = {}  # rows that a cell above still covers, by column
        self.caption: list[str] = []

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        self.covered, self.held = self.held, {c: n - 1 for c, n in self.held.items() if n > 1}

    def cell(self, lines: list[str], colspan: int, rowspan: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.covered:
            self.column += 1
        self.rows[-1].append((self.column, colspan, lines))
        if rowspan > 1:
            self.held.update({self.column + k: rowspan - 1 for k in range(colspan)})
        self.column += colspan

    def laid_out(self) -> list[str]:
        """Cells of a column begin at the same place, two spaces apart; a cell's lines stand under one another."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, span, lines in row:
                own = max((len(x) for x in lines if len(x) <= PADDED), default=0) if span == 1 else 0
                widths[column] = max(widths.get(column, 0), own)
        starts, at = {}, 0
        for column in sorted(widths):
            starts[column] = at
            at += widths[column] + 2
        out = list(self.caption)
        for row in self.rows:
            for k in range(max((len(lines) for *_, lines in row), default=0)):
                line = ""
                for column, _, lines in row:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(starts[column])
                        line += ("  " if len(line) > starts[column] else "") + lines[k]
                out.append(line)
        return [x for x in out if x]


def _number(value: str | None, default: int, most: int = 1000) -> int:
    return min(most, max(1, int(value))) if value and re.fullmatch(r"\s*\d{1,9}\s*", value) else default


def _list_box(attrs: dict[str, str]) -> bool:
    """Whether a select shows all its options."""
    return "multiple" in attrs or _number(attrs.get("size"), 1) > 1


def render(root: Node) -> str:
    """The visible text: blocks on lines of their own, list items marked and indented, table cells in columns."""
    out = Writer()
    # what is left to do, last first: a node to enter, text, or a function that leaves a node
    todo: list = [(root, True, False)]
    writers, tables, counters = [out], [], []

    def leave(action):
        todo.append(action)

    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, shown, as_is = item
        w = writers[-1]
        if isinstance(node, str):
            if shown:
                w.text(node, as_is)
            continue
        tag, attrs = node.tag, node.attrs
        if tag in HIDDEN or "hidden" in attrs or tag == "dialog" and "open" not in attrs:
            continue
        foreign = node.foreign
        if foreign:
            if tag in HIDDEN_IN[foreign] or foreign == "svg" and attrs.get("display", "").strip().lower() == "none":
                continue
            if foreign == "svg" and "visibility" in attrs:
                shown = attrs["visibility"].strip().lower() not in ("hidden", "collapse")
        style = attrs.get("style")
        if style:
            if _NO_DISPLAY.search(style):
                continue
            if seen := _VISIBILITY.findall(style):
                shown = seen[-1].lower() not in ("hidden", "collapse")
        children = node.children
        if tag == "br":
            w.end_line(True)
            continue
        if tag == "details" and "open" not in attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            options, below = [], children[::-1]
            while below:
                c = below.pop()
                if isinstance(c, Node) and c.tag == "option":
                    options.append(c)
                elif isinstance(c, Node) and c.tag not in HIDDEN:
                    below += reversed(c.children)
            if not _list_box(attrs):
                children = [c for c in options if "selected" in c.attrs][:1] or options[:1]
                children = children[0].children if children else []
        elif tag == "optgroup" and attrs.get("label"):
            children = [attrs["label"], *children]
        elif tag in APART and foreign:
            children = [x for c in children for x in (c, " ")]
        as_is = as_is or tag in ("pre", "textarea", "xmp")
        if tag == "table":
            w.block(1)
            table = Table()
            tables.append(table)

            def done(w=w):
                w.block(1)
                w.rows(tables.pop().laid_out())
                w.block(1)

            leave(done)
            # captions and rows only; anything else in a table stands before it
            astray = [c for c in children if not (isinstance(c, Node) and c.tag in ("tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col")) and not (isinstance(c, str) and not c.strip())]
            inside = [c for c in children if isinstance(c, Node) and c.tag in ("tr", "tbody", "thead", "tfoot", "caption")]
            children = astray + inside
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in ("td", "th", "caption") and tables:
            writers.append(Writer())

            def cell(tag=tag, attrs=attrs):
                own = writers.pop()
                own.end_line()
                lines = own.lines
                if tag == "caption":
                    tables[-1].caption += lines
                else:
                    tables[-1].cell(lines, _number(attrs.get("colspan"), 1), _number(attrs.get("rowspan"), 1))

            leave(cell)
        elif tag in BLOCKS or foreign and (tag in LINES_IN[foreign] or tag == "math" and attrs.get("display", "").lower() == "block"):
            blank = int(tag in SPACED and not (tag in LISTS and counters))
            w.block(blank)
            extra = ""
            if tag in ("ul", "ol", "menu", "dl"):
                counters.append(_number(attrs.get("start"), 1, 10**9) if tag == "ol" else 0)
            elif tag == "li":
                if counters and counters[-1]:
                    counters[-1] = _number(attrs.get("value"), counters[-1], 10**9)
                    w.marker = f"{counters[-1]}. "
                    counters[-1] += 1
                else:
                    w.marker = "- "
                extra = " " * len(w.marker)
            elif tag in ("dd", "blockquote"):
                extra = "  "
            if extra:
                w.indents.append(extra)

            def close(w=w, blank=blank, extra=extra, listed=tag in LISTS):
                w.block(blank)
                if extra:
                    w.indents.pop()
                    w.marker = ""
                if listed:
                    counters.pop()

            leave(close)
        todo.extend((c, shown, as_is) for c in reversed(children))
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page with its visible text.

    Left out are scripts, styles, the head and other elements that show no text, elements with `hidden`, with
    display:none or visibility:hidden in their style (a visible descendant of the latter shows), closed details but for
    their summary, closed dialogs, options not selected, and what svg and math only define or describe. White space collapses except in preformatted text.

    A null or empty page gives empty text; broken markup is read as far as it goes. Repeated rows are read each for
    itself, a null id stays null, other columns are ignored, an empty table gives no rows. One narrow pass, a page at a
    time, in time proportional to the page: nesting takes no recursion and padding has a limit.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in texts(batches, 64):
            found = [render(tree(page)) for page in batch]
            arrays = [
                pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()),
                pa.array([t.count("\n") + 1 if t else 0 for t in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "text", "n_chars", "n_lines"])

    return id_and_text(pages, id_col, html_col).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
