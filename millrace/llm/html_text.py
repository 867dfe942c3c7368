"""HTML extraction: a small tree builder, visibility rules and a layout-aware renderer.

The tokenizer goes over a page once and never back: what an unfinished tag or comment opens ends
with the page.  The builder inserts implied tags (a paragraph ends where a block begins, items,
cells and rows end where the next one begins, the head where content begins) and keeps an end tag
from closing more than its element's scope.  The renderer emits all visible text: blocks are set
apart by blank lines, list items get a marker and their lines its width, `pre` keeps its spacing,
and the cells of a table row are padded to their columns.  Nothing is recursive, and a page takes
time in proportion to its size at any depth.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._shared import with_computed

_WS = " \t\n\r\f"
_SPACE = re.compile(r"[ \t\n\r\f]+")
_OPEN = re.compile(r"<(?:[!?/]|[A-Za-z])")
_LETTER = re.compile(r"[A-Za-z]")
_NAME = re.compile(r"[^ \t\n\r\f/>]+")
#: What stands before an attribute, then the tag's end or the attribute: name and value in one of three forms.
_ATTRIBUTE = re.compile(r"""([ \t\n\r\f/]*+)(?:(>)|(=?[^ \t\n\r\f/>=]++|=)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)?+))?+)""")
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT_END, _TAG_END = re.compile(r"--!?>"), re.compile(">")
_READ = frozenset(("hidden", "aria-hidden", "style", "type", "start", "alt", "open", "value"))

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NEVER_SHOWN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas annotation annotation-xml datalist title".split())
#: Inputs that don't show their value as text.
MUTE_INPUTS = frozenset("hidden checkbox radio file image range color password".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote figure hr article section".split())
ENDS_P = BLOCK - frozenset("body html option optgroup legend td th tr tbody thead tfoot caption dd dt li summary".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
FOREIGN = frozenset(("svg", "math"))
#: What shows text inside svg.
SVG_TEXT = frozenset(("text", "foreignobject"))
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: Start tag -> open elements that it ends, and those beyond which it doesn't look.
IMPLIED_ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"td", "th", "tr"}, {"table"}), "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
}
#: Start tags that leave an open head open; any other one, and any text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: An end tag doesn't close past these; that of an element in no class doesn't close past any block.
_CELLS = frozenset(("table", "td", "th", "caption", "template", "object"))
SCOPE = {"li": LISTS | _CELLS, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "caption": {"table"}, "table": {"template"}, "template": set(), "object": set(), "body": set()}
_ANY_BLOCK = "*"  # the key of open blocks, whatever their tag

class Layout(NamedTuple):
    """Bounds of the layout, never of the text; None is no bound."""

    indents: int | None = 20  # nested lists beyond this many indents stand no further to the right
    tables: int | None = 6  # tables inside this many others are written cell by cell
    align_times: int | None = 16  # a table is aligned while that takes at most so many characters for each of its text's,
    align_free: int = 4096  # and these besides


class Node:
    """An element.  `dark` ones are hidden where they begin, and `live` ones have shown content all the same."""

    __slots__ = ("tag", "start", "children", "dark", "live", "weight", "source", "outer", "visible", "ended", "told")

    def __init__(self, tag: str, start: int = 1):
        self.tag, self.start, self.children = tag, start, []
        self.dark = self.live = self.ended = self.told = False
        self.weight = 0  # what it adds to the number of hiding elements: 1 hides, -1 shows inside one that hides
        self.source: Node | None = None  # the element whose `visibility` holds in it, if any has one
        self.outer, self.visible = None, True  # of such an element: the next one outside


_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I) for tag in RAW}


def read_tag(page: str, at: int) -> tuple[str, dict[str, str], bool, int] | None:
    """(tag, attributes that matter, whether it closes itself, place behind it); None if the page ends inside."""
    m = _NAME.match(page, at)
    tag, attributes = m[0].lower(), {}
    while m := _ATTRIBUTE.match(page, m.end()):
        if m[2]:
            return tag, attributes, m[1].endswith("/"), m.end()
        name = m[3].lower()
        if name in _READ and name not in attributes:
            attributes[name] = html.unescape(m[4] or m[5] or m[6] or "")
    return None


def _hides(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("dialog", "details", "svg"):  # what of a closed element, or of a picture, is shown is said where it begins
        closed = tag == "svg" or "open" not in attributes
    else:
        closed = tag in NEVER_SHOWN
    return closed or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", ""))) or (tag == "input" and attributes.get("type", "").lower() == "hidden")


class _Tree:
    """The open elements of a page, with their places by tag."""

    def __init__(self):
        self.stack = [Node("html")]
        self.stack[0].live = True
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.hiding = 0  # the open elements' weights

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close(self, tags, bounds=()) -> bool:
        """Close the last open element of these tags and all inside it, unless a bound stands between."""
        i = self.last(tags)
        if not i or i < self.last(bounds):
            return False
        for x in self.stack[i:]:
            if x.ended:
                continue
            self.hiding -= x.weight
            self.places[x.tag].pop()
            if x.tag in BLOCK:
                self.places[_ANY_BLOCK].pop()
        del self.stack[i:]
        return True

    def visibility(self, node: Node) -> Node | None:
        """The element whose visibility holds in `node`; ended ones are passed over, once."""
        while node.source is not None and node.source.ended:
            node.source = node.source.outer
        return node.source

    def shows(self, weight: int = 0, source: Node | None = None) -> bool:
        source = source or self.visibility(self.stack[-1])
        return self.hiding + weight == 0 and (source is None or source.visible)

    def lives(self) -> None:
        """Something is shown in the open elements; each is told so once."""
        for x in reversed(self.stack):
            if x.live:
                return
            x.live = True

    def add(self, child: Node | str) -> None:
        """Hidden text is left out; an element is dark if it's hidden where it begins."""
        shown = self.shows()
        if isinstance(child, Node):
            child.dark = not shown
        elif not shown:
            return
        else:
            self.lives()
        self.stack[-1].children.append(child)

    def open(self, node: Node) -> None:
        self.hiding += node.weight
        for key in (node.tag, _ANY_BLOCK) if node.tag in BLOCK else (node.tag,):
            self.places[key].append(len(self.stack))
        self.stack.append(node)

    def text(self, text: str) -> None:
        if text.strip(_WS):
            self.close({"head"}, {"template"})
        self.add(text)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.add(Node("br"))
        elif self.close({tag}, SCOPE.get(tag, _CELLS if tag in BLOCK else {_ANY_BLOCK})):
            return
        elif tag == "p":
            self.add(Node("p"))
        elif tag in FORMATTING and self.last({tag}) > self.last(_CELLS):
            # blocks are open inside a formatting element: what they hold so far stays formatted, and hidden with it, what follows doesn't
            node = self.stack[self.places[tag].pop()]
            node.ended = True
            self.hiding -= node.weight

    def start(self, tag: str, attributes: dict[str, str], closes_itself: bool) -> bool:
        """Whether a raw element opens, whose text the caller reads."""
        if tag not in IN_HEAD:
            self.close({"head"}, {"template"})
        if tag in ENDS_P:
            self.close({"p"}, _CELLS | {"button"})
        if tag in IMPLIED_ENDS:
            while self.close(*IMPLIED_ENDS[tag]):
                pass
        if tag == "html":
            return False
        start = attributes.get("start", "")
        node, top = Node(tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1), self.stack[-1]
        node.weight = int(_hides(tag, attributes))
        if tag == "summary" and top.tag == "details" and not top.told:
            node.weight, top.told = node.weight - top.weight, True
        elif tag in SVG_TEXT and self.last(SVG_TEXT) < self.last({"svg"}):
            node.weight -= 1
        node.source = self.visibility(top)
        if said := _VISIBILITY.findall(attributes.get("style", "")):
            node.outer, node.source, node.visible = node.source, node, said[-1].lower() == "visible"
        if tag == "img" and attributes.get("alt"):
            node.children.append(attributes["alt"])
        elif tag == "input" and attributes.get("value") and attributes.get("type", "").lower() not in MUTE_INPUTS:
            node.children.append(attributes["value"])
        top.children.append(node)
        node.dark = not self.shows(node.weight, node.source)
        if not node.dark and (tag in VOID or tag in RAW):
            self.lives()
        if tag in VOID or closes_itself and (tag in FOREIGN or self.last(FOREIGN)):
            return False
        if tag not in RAW:
            self.open(node)
        return tag in RAW


def build(page: str) -> Node:
    """The page's tree: Nodes and strings."""
    tree, at, size = _Tree(), 0, len(page)
    while at < size:
        m = _OPEN.search(page, at)
        upto = m.start() if m else size
        if upto > at:
            tree.text(html.unescape(page[at:upto]))
        if not m:
            break
        closing = page[upto + 1] == "/"
        at = upto + 2 if closing else upto + 1
        if not _LETTER.match(page, at):  # a comment, a declaration or a closing tag without a name
            comment = page.startswith("<!--", upto)
            found = _COMMENT_END.search(page, upto + 2) if comment else _TAG_END.search(page, upto + 2)
            at = found.end() if found else size
            continue
        tag = read_tag(page, at)
        if tag is None:
            break
        name, attributes, closes_itself, at = tag
        if closing:
            tree.end(name)
        elif tree.start(name, attributes, closes_itself):
            stop = _RAW_ENDS[name].search(page, at)
            inner = page[at : stop.start() if stop else size]
            tree.stack[-1].children[-1].children.append(html.unescape(inner) if name in ("title", "textarea") else inner)
            at = size
            if stop and (tag := read_tag(page, stop.start() + 2)):
                at = tag[3]
    return tree.stack[0]


class Writer:
    """Lines of text; collapses white space and keeps at most one blank line between blocks.

    Lines begin with the indents of the open list items, an item's first line with its marker.
    Blocks inside an item stand together, without blank lines.
    """

    def __init__(self, indents: int | None):
        self.most_indents = indents
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indents: list[str] = []  # of the open items: the marker until a line has shown it, then spaces
        self.fresh: list[int] = []  # items whose first line is still to come
        self.chars = 0  # of text, without padding and indents

    def text(self, s: str) -> None:
        body = " ".join(x for x in _SPACE.split(s) if x)
        if not body:
            self.space = self.space or (bool(s) and bool(self.line))
            return
        if self.line and (self.space or s[0] in _WS):
            self.line.append(" ")
        self._begin()
        self.line.append(body)
        self.chars += len(body)
        self.space = s[-1] in _WS

    def raw(self, s: str, padded: bool = False) -> None:
        """Text as it is; that of an aligned table is counted by its cells."""
        for i, x in enumerate(s.split("\n")):
            if i:
                self._flush()
            if x:
                self._begin()
                self.line.append(x)
        self.chars += 0 if padded else len(s)

    def _begin(self) -> None:
        if self.line:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if self.indents:
            most = self.most_indents
            self.line += self.indents if most is None or len(self.indents) <= most else [*self.indents[: most - 1], self.indents[-1]]
            for i in self.fresh:
                self.indents[i] = " " * len(self.indents[i])
            self.fresh.clear()

    def _flush(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line = []

    def indent(self, marker: str) -> None:
        self.end_line()
        self.fresh.append(len(self.indents))
        self.indents.append(marker)

    def outdent(self) -> None:
        self.end_line()
        self.indents.pop()
        if self.fresh and self.fresh[-1] == len(self.indents):
            self.fresh.pop()

    def end_line(self, blank: bool = False) -> None:
        if self.line:
            self._flush()
        self.space = False
        self.blank = self.blank or blank and not self.indents

    def done(self) -> list[str]:
        self.end_line()
        first = next((i for i, x in enumerate(self.lines) if x), len(self.lines))
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines[first:]


def _run(job):
    """The result of a generator that yields further ones and is sent theirs; pages nest deeper than calls can."""
    jobs, value = [job], None
    while jobs:
        try:
            jobs.append(jobs[-1].send(value))
            value = None
        except StopIteration as end:
            jobs.pop()
            value = end.value
    return value


def render(root: Node, layout: Layout = Layout()) -> str:
    out = Writer(layout.indents)
    _run(_render(root, out, layout, False, 0))
    return "\n".join(out.done())


def _unseen(x: Node) -> bool:
    return x.dark and not x.live


def _render(node: Node, out: Writer, layout: Layout, pre: bool, tables: int):
    """Writes the content of `node`, which stands in so many tables."""
    number = node.start
    for n, x in enumerate(node.children):
        if isinstance(x, str):
            if pre:
                out.raw(x.removeprefix("\n") if node.tag == "pre" and not n else x)
            else:
                out.text(x)
            continue
        if _unseen(x):
            continue
        tag = x.tag
        if tag == "br":
            if out.line:
                out.end_line()
            else:
                out.end_line(True)
        elif tag == "hr":
            out.end_line(True)
        elif tag == "li":
            out.indent(f"{number}. " if node.tag == "ol" else "- ")
            number += 1
            yield _render(x, out, layout, pre, tables)
            out.outdent()
        elif tag == "table" and (layout.tables is None or tables < layout.tables):
            out.end_line(True)
            yield _table(x, out, layout, tables + 1)
            out.end_line(True)
        elif tag in BLOCK or tag == "xmp":
            nested = tag in LISTS and node.tag in LISTS
            out.indent("  ") if nested else out.end_line(tag in SPACED)
            yield _render(x, out, layout, pre or tag in ("pre", "xmp"), tables)
            out.outdent() if nested else out.end_line(tag in SPACED)
        else:
            yield _render(x, out, layout, pre or tag == "textarea", tables)


def _rows(table: Node):
    """Rows of a table as lists of their children, other content alone."""
    for x in table.children:
        inner = x.children if isinstance(x, Node) and x.tag in ("tbody", "thead", "tfoot") and not _unseen(x) else [x]
        for y in inner:
            if isinstance(y, str):
                if y.strip(_WS):
                    yield y
            elif _unseen(y) or y.tag in ("colgroup", "col"):
                continue
            elif y.tag == "tr":
                yield y.children
            elif y.tag in ("td", "th"):
                yield [y]
            else:
                yield y


def _lines(node: Node, out: Writer, layout: Layout, tables: int):
    """The lines of a node alone, whose characters `out` counts."""
    own = Writer(layout.indents)
    yield _render(node, own, layout, False, tables)
    lines = own.done()
    out.chars += own.chars
    return lines


def _table(table: Node, out: Writer, layout: Layout, tables: int):
    """Cells of a row side by side, padded to the width of their column; other content stands alone."""
    grid: list[tuple[bool, list[list[str]]]] = []  # (whether a row of cells, the lines of each)
    before = out.chars
    for row in _rows(table):
        cells, loose = [], []
        for c in row if isinstance(row, list) else [row]:
            if isinstance(c, str):
                if text := " ".join(x for x in _SPACE.split(c) if x):
                    out.chars += len(text)
                    loose.append([text])
            elif not _unseen(c):
                lines = yield _lines(c, out, layout, tables)
                (cells if c.tag in ("td", "th") else loose).append(lines)
        grid += [(False, [x]) for x in loose]
        if any(cells):
            grid.append((True, cells))
    widths: list[int] = []
    for is_row, cells in grid:
        if is_row:
            widths += [0] * (len(cells) - len(widths))
            for i, c in enumerate(cells):
                widths[i] = max(widths[i], max(map(len, c), default=0))
    ends = [0]
    for w in widths:
        ends.append(ends[-1] + w + 2)
    area = sum(max(map(len, cells)) * ends[len(cells)] for is_row, cells in grid if is_row)
    aligned = layout.align_times is None or area <= layout.align_times * (out.chars - before) + layout.align_free
    for is_row, cells in grid:
        if is_row and aligned:
            lines = ["  ".join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(cells)).rstrip() for k in range(max(map(len, cells)))]
        else:
            lines = [x for c in cells for x in c]
        for x in lines:
            out.raw(x, True)
            out.end_line()


def page_text(page: str | None, layout: Layout = Layout()) -> str:
    return render(build(page.replace("\r\n", "\n").replace("\r", "\n")), layout) if page else ""


def extract_text(pages: DataFrame, html_col: str = "html", layout: Layout = Layout()) -> DataFrame:
    """All columns of `pages` but the markup, and text: the page's visible text.

    A null or empty page gives an empty text.  Unclosed elements end with the page, stray end tags
    are ignored.  Pages are rendered alone: ids may be null or repeat.  One pass, no shuffle.  An
    input column named `text`, in any case, is replaced.  The default layout keeps the output in
    proportion to the page; one without bounds may take much more for deep lists and wide tables.
    """
    read = partial(page_text, layout=layout)
    return with_computed(pages, html_col, "text string", lambda pages: [pa.array([read(x) for x in pages.to_pylist()], pa.string())], keep=False)
