"""Layout-aware text of web pages.

A tree builder reads the tags of a page, closes what the standard lets authors leave open, and leaves
out what a browser would not show.  The renderer then walks the tree: blocks stand on lines of their
own with blank lines between paragraphs, list items carry their mark and depth, and the cells of a table
row are padded to the width of their column.  All visible text is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe object datalist audio video canvas svg math noembed noframes title meta link param source track area base".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp caption").split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure listing xmp menu dir".split())
#: What an opening tag closes: the open elements, and where the search for them stops.
_TABLE = frozenset(["table", "template", "html"])
_SECTIONS = frozenset("thead tbody tfoot".split())
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), _TABLE | {"tr"}), "th": (frozenset(["td", "th"]), _TABLE | {"tr"}),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), _TABLE),
    **{s: (frozenset(["td", "th", "tr", "caption", "colgroup"]) | _SECTIONS, _TABLE) for s in _SECTIONS},
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])), "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
CLOSES_P = BLOCK - frozenset("body html option optgroup legend caption".split())
#: An open element that stands between a closing tag and its partner only if the tag is for a block.
SCOPE = frozenset("table td th caption template html".split())

#: Tables within tables that are still aligned.
NESTED = 40

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class Open(list):
    """The open elements; counts per tag spare a walk through a deep stack for what is not there."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.counts: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.counts[node.tag] += 1

    def cut(self, depth: int) -> None:
        self.counts.subtract(n.tag for n in self[depth:])
        del self[depth:]


def _close(stack: Open, tags: frozenset, stop: frozenset) -> None:
    """Pop every element of ``tags`` that is open inside the nearest of ``stop``."""
    left, outermost = sum(stack.counts[t] for t in tags), None
    for depth in range(len(stack) - 1, 0, -1):
        if not left or stack[depth].tag in stop:
            break
        if stack[depth].tag in tags:
            outermost, left = depth, left - 1
    if outermost is not None:
        stack.cut(outermost)


def parse(source: str) -> Node:
    """The element tree of a page; text nodes are strings with their entities resolved."""
    root = Node("html")
    stack, at = Open(root), 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        if found is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if found.start() > at:
            stack[-1].children.append(html.unescape(source[at:found.start()]))
        at = found.end()
        end, start = found.group(1), found.group(2)
        if start:
            tag = start.lower()
            if tag in ("html", "body"):
                stack[0].attributes.update(_attributes(found.group(3)))
                _close(stack, frozenset(["head"]), frozenset())
                continue
            if tag in CLOSES_P:
                _close(stack, frozenset(["p"]), SCOPE)
            if tag in CLOSES_P and stack[-1].tag == "head":
                stack.cut(len(stack) - 1)
            if tag in IMPLIED:
                _close(stack, *IMPLIED[tag])
            node = Node(tag, _attributes(found.group(3)) if found.group(3).strip(" /\n\t") else None)
            stack[-1].children.append(node)
            if tag in RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at) if tag != "plaintext" else None
                inner = source[at:closing.start() if closing else len(source)]
                node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
                at = closing.end() if closing else len(source)
            elif tag not in VOID and not (found.group(3).rstrip().endswith("/") and tag in ("svg", "math", "path")):
                stack.push(node)
        elif end:
            tag = end.lower()
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not stack.counts["p"]:
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body") and stack.counts[tag] > 0:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        stack.cut(depth)
                        break
                    if stack[depth].tag in SCOPE and tag not in SCOPE and tag not in _SECTIONS | {"tr"}:
                        break
        elif found.group(0).startswith("<![CDATA["):
            stack[-1].children.append(found.group(0)[9:].removesuffix("]]>"))
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden")
                or (node.tag == "dialog" and "open" not in a) or _NONE.search(a.get("style", "")))


class Lines:
    """Text as it grows: runs are joined with single blanks, blocks break the line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.blank = False

    def text(self, value: str) -> None:
        self.run.append(value)

    def end_line(self, always: bool = False) -> None:
        line = _SPACE.sub(" ", "".join(self.run)).strip(" ")
        self.run.clear()
        if line or always:
            self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def space(self) -> None:
        self.end_line()
        self.blank = True


def _cells(row: Node) -> list[Node]:
    return [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]


def _table(node: Node, depth: int) -> list[str]:
    """Rows with their cells padded to the width of the column; a cell of several lines stays a column."""
    rows, loose, captions = [], [], []
    open_nodes = [iter(node.children)]
    while open_nodes:
        child = next(open_nodes[-1], None)
        if child is None:
            open_nodes.pop()
        elif isinstance(child, Node) and child.tag == "tr" and visible(child):
            rows.append([render(c, depth) for c in _cells(child)])
            loose += [c for c in child.children if not (isinstance(c, Node) and c.tag in ("td", "th"))]
        elif isinstance(child, Node) and child.tag in _SECTIONS | {"colgroup"} and visible(child):
            open_nodes.append(iter(child.children))
        elif isinstance(child, Node) and child.tag == "caption" and visible(child):
            captions += render(child, depth)
        elif isinstance(child, Node) and child.tag in ("td", "th") and visible(child):
            rows.append([render(child, depth)])
        else:
            loose.append(child)
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            width = max(map(len, cell), default=0)
            if k < len(widths):
                widths[k] = max(widths[k], width)
            else:
                widths.append(width)
    # A row of very wide cells would pad every other row: padding stops at eighty characters.
    widths = [min(w, 80) for w in widths]
    outside = Node("div")
    outside.children = loose
    out = captions + render(outside, depth)
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(widths[j]) for j, cell in enumerate(row)).rstrip())
    return out


def render(node: Node, depth: int = 0) -> list[str]:
    """The visible lines of a subtree.  The walk keeps its own stack, so depth is not limited; tables
    inside ``NESTED`` other tables are shown as plain rows."""
    out, todo = Lines(), [("open", node, None)]
    prefix: list[str] = []
    while todo:
        step, item, extra = todo.pop()
        if step == "text":
            out.text(item)
        elif step == "pre":
            for k, line in enumerate(item.split("\n")):
                if k:
                    out.put("".join(out.run).rstrip() if out.run else "")
                    out.run.clear()
                out.run.append(line)
        elif step == "close":
            tag = item.tag
            if tag in ("pre", "listing", "xmp", "textarea") and out.run:
                out.put("".join(out.run).rstrip())
                out.run.clear()
            if tag in BLOCK or tag == "tr":
                out.end_line()
            if extra is not None:  # a list item: its lines hang under its mark
                mark, before = extra
                inner = out.lines
                out = before
                pad = " " * len(mark)
                for k, line in enumerate(inner or [""]):
                    out.put((mark if k == 0 else pad if line else "") + line)
            if tag in SPACED:
                out.blank = True
        elif step == "open":
            tag = item.tag
            if item is not node and not visible(item):
                continue
            if tag == "br":
                out.end_line(always=True)
                continue
            if tag == "hr":
                out.end_line()
                continue
            if tag == "wbr":
                continue
            if tag == "table" and item is not node and depth < NESTED:
                out.space()
                for line in _table(item, depth + 1):
                    out.put(line)
                out.blank = True
                continue
            if tag in BLOCK:
                out.end_line()
                if tag in SPACED:
                    out.blank = True
            if tag in ("td", "th") and item is not node:
                out.text(" ")
            extra = None
            if tag == "li" and item is not node:
                mark = f"{item.attributes['_n']}. " if "_n" in item.attributes else "- "
                extra, out = (mark, out), Lines()
            elif tag == "dd" and item is not node:
                extra, out = ("    ", out), Lines()
            if tag == "ol":
                n = int(item.attributes["start"]) if re.fullmatch(r"-?[0-9]{1,9}", item.attributes.get("start", "")) else 1
                for child in item.children:
                    if isinstance(child, Node) and child.tag == "li" and visible(child):
                        if re.fullmatch(r"-?[0-9]{1,9}", child.attributes.get("value", "")):
                            n = int(child.attributes["value"])
                        child.attributes["_n"] = str(n)
                        n += 1
            todo.append(("close", item, extra))
            whole = tag in ("pre", "listing", "xmp", "textarea", "plaintext")
            for child in reversed(item.children):
                if isinstance(child, Node):
                    todo.append(("open", child, None))
                else:
                    todo.append(("pre" if whole else "text", child, None))
            if tag in ("option", "button", "label", "summary"):
                out.text(" ")
    out.end_line()
    return out.lines


def page_text(source: str | None) -> str:
    """All visible text of one page; empty for a null or empty one."""
    return "\n".join(render(parse(source))).strip("\n") if source else ""


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text`` for every row of ``pages``.  A null or empty page, and one with nothing visible,
    has an empty text; broken markup is read as a browser would go on with it; repeated rows are each
    rendered; an empty table gives no rows; other columns are ignored whatever their names."""
    picked = pages.select(F.col(id_col).alias("_id"), F.col(html_col).cast("string").alias("_html"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x.as_py()) for x in batch.column(1)], pa.string())], names=["_id", "text"])
    return picked.mapInArrow(run, f"_id {picked.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)
