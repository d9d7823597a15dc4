"""HTML extraction: the visible text of a page, laid out.

A tree builder opens html, head and body as needed, closes what a start tag implies (p, li, dd, option, tr, td
and so on) and matches end tags to the nearest open element in their scope. Elements that a browser does not
show (by tag, the hidden attribute, an inline display:none or visibility:hidden, a closed details) are
left out with all they hold. Blocks start lines, paragraphs and their like are set off by an empty line,
list items carry bullets or numbers and their nesting's indent, pre keeps its lines, and a table's
cells are padded to its columns' widths.

Content of a table outside its cells comes before the grid. Neither building nor rendering recurses, and each
tag takes a time that does not depend on the depth. Two widths are bounds of layout, not of content: lines indent by at
most INDENT columns, and cells after a column wider than WIDEST follow it without alignment.

A null or empty page gives an empty text. Broken markup never fails. Rows that repeat are rendered alike; other
columns pass. No rows give no rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object svg math canvas audio video datalist select map".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside details summary dialog dd div dt figcaption footer form header hgroup legend li main menu nav search section center caption tr thead tbody tfoot td th".split())
CLOSES_P = SPACED | frozenset("address article aside details dialog div figcaption footer form header hgroup main menu nav search section center li dd dt".split())
#: A start tag of the key closes open elements of the first set, up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: An end tag does not reach past these.
WALLS = {"li": {"ul", "ol"}, "p": {"table", "td", "th"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


INDENT, WIDEST = 160, 240


class Node:
    """lines: of a table, once it is laid out."""

    __slots__ = ("tag", "attrs", "kids", "lines")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.kids, self.lines = tag, attrs or {}, [], None


class Open:
    """The stack of open elements, with the places of each tag."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node):
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def top(self) -> Node:
        return self.stack[-1]

    def add(self, kid):
        self.stack[-1].kids.append(kid)

    def last(self, tags) -> int:
        return max([self.places[t][-1] for t in tags if self.places.get(t)], default=0)

    def close(self, tags, walls=()) -> bool:
        """Closes the nearest open element of `tags`, unless one of `walls` is nearer."""
        at = self.last(tags)
        if not at or self.last(walls) > at:
            return False
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()
        return True


def build(page: str) -> Node:
    root = Node("html")
    opened = Open(root)
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            opened.add(html.unescape(page[at:]))
            break
        if m.start() > at:
            opened.add(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                opened.add(Node("br"))
            elif tag not in ("html", "body"):
                opened.close((tag,), WALLS.get(tag, ()))
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(m[3])} if m[3].strip(" \n\t/") else {}
        if tag == "html":
            continue
        if tag == "body":
            opened.close(("head",))
            root.attrs.update(attrs)
            continue
        if opened.places.get("head") and tag not in ("head", "meta", "link", "title", "style", "script", "base", "template", "noscript"):
            opened.close(("head",))  # anything else starts the body
        if tag in IMPLIED:
            while opened.close(*IMPLIED[tag]):
                pass
        if tag in CLOSES_P:
            opened.close(("p",), ("table", "td", "th", "button"))
        if tag in ("td", "th") and opened.top().tag != "tr" and opened.places.get("table"):
            row = Node("tr")
            opened.add(row)
            opened.push(row)
        node = Node(tag, attrs)
        opened.add(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            if tag in ("textarea", "title"):
                node.kids.append(html.unescape(page[at:stop]))
            elif tag == "xmp":
                node.kids.append(page[at:stop])
            at = stop
            if end:
                at = page.find(">", stop) + 1 or n
            continue
        opened.push(node)
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or "hidden" in a or bool(a.get("style") and INVISIBLE.search(a["style"]))


class Lines:
    """Text laid out line by line; `gap` says whether the next text needs a new line (1) or an empty one (2)."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space = [], [], 0, False
        self.indent, self.mark = 0, ""

    def block(self, gap):
        self.flush()
        self.gap = max(self.gap, gap)

    def flush(self, even_empty=False):
        text = "".join(self.line).rstrip(" ")
        self.line, self.space = [], False
        if text or even_empty:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = " " * max(0, min(self.indent, INDENT) - len(self.mark)) + self.mark
            self.mark = ""
            self.lines.append(lead + text if text else "")

    def whole(self, lines):
        """Lines that are laid out already."""
        for i, line in enumerate(lines):
            if i and not self.indent:  # nothing to add to the others
                self.lines += lines[i:]
                break
            self.line = [line]
            self.flush(even_empty=True)

    def text(self, s, pre):
        if pre:
            for i, part in enumerate(s.expandtabs(8).split("\n")):
                if i:
                    self.flush(even_empty=bool(self.lines or self.line))
                if part:
                    self.line.append(part)
            return
        for i, part in enumerate(SPACES.split(s)):
            if i and self.line and not self.space:
                self.line.append(" ")
                self.space = True
            if part:
                self.line.append(part)
                self.space = False


def rendered(root: Node) -> list[str]:
    """Lines of a subtree whose tables are laid out."""
    out = Lines()
    lists: list[list] = []
    work: list = [(root, False, False)]  # node or text, within pre, whether leaving
    while work:
        node, pre, leaving = work.pop()
        if isinstance(node, str):
            out.text(node, pre)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dd", "blockquote"):
                out.flush()
                out.indent -= 4 if tag == "dd" else 2 if tag == "blockquote" else lists.pop()[2]
            if tag == "li":
                out.flush()
                if out.mark:
                    out.lines.append((" " * max(0, min(out.indent, INDENT) - len(out.mark)) + out.mark).rstrip())
                    out.mark = ""
            if tag in BLOCK:
                out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            continue
        if hidden(node):
            continue
        if tag == "br":
            out.flush(even_empty=True)
            continue
        if tag == "input":
            if node.attrs.get("type", "text").lower() != "hidden" and node.attrs.get("value"):
                out.text(node.attrs["value"], False)
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK:
            out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
        if tag == "hr":
            continue
        if tag == "table":
            out.whole(node.lines)
            out.block(2)
            continue
        if tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start", "1")
            items = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
            first = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            width = 2 if tag != "ol" else len(str(first + max(0, items - 1))) + 2
            lists.append([tag, first, width])
            out.indent += width
        if tag == "li":
            if lists and lists[-1][0] == "ol":
                value = node.attrs.get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    lists[-1][1] = int(value)
                out.mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                out.mark = "- "
        if tag in ("dd", "blockquote"):
            out.indent += 4 if tag == "dd" else 2
        kids = node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        work.append((node, pre, True))
        within = pre or tag in ("pre", "textarea", "xmp", "listing")
        work += [(k, within, False) for k in reversed(kids)]
    out.flush()
    return out.lines


def grid(table_node: Node) -> list[str]:
    """A table's misplaced content, caption and rows, cells padded to their columns."""
    captions, rows, spans = [], [], {}
    outside = Node("div")
    work = [(k, False) for k in reversed(table_node.kids)]
    while work:
        node, in_row = work.pop()
        if isinstance(node, str):
            outside.kids.append(node)
        elif hidden(node) or node.tag in ("col", "colgroup"):
            continue
        elif node.tag == "caption" and not in_row:
            captions += rendered(node)
        elif node.tag in ("tbody", "thead", "tfoot") and not in_row:
            work += [(k, False) for k in reversed(node.kids)]
        elif node.tag == "tr" and not in_row:
            row, column = {}, 0
            for cell in node.kids:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    outside.kids.append(cell)
                    continue
                if hidden(cell):
                    continue
                while spans.get(column, 0) > 0:
                    spans[column] -= 1
                    column += 1
                across, down = (int(v) if re.fullmatch(r"[1-9]\d{0,2}", v := cell.attrs.get(a, "1")) else 1 for a in ("colspan", "rowspan"))
                inner = Node("td")
                inner.kids = cell.kids
                row[column] = (rendered(inner), across)
                for c in range(column, column + across):
                    spans[c] = down - 1
                column += across
            for c in [c for c, left in spans.items() if c >= column and left > 0]:
                spans[c] -= 1
            spans = {c: left for c, left in spans.items() if left > 0}
            rows.append(row)
        else:
            outside.kids.append(node)
    width: dict[int, int] = {}
    for row in rows:
        for c, (lines, across) in row.items():
            width.setdefault(c, 0)
            if across == 1:
                width[c] = max([width[c], *map(len, lines)])
    start, reach = {}, 0
    for c in sorted(width):
        start[c] = reach
        reach += (width[c] if width[c] <= WIDEST else 0) + 2
    before = rendered(outside)
    out = before + captions
    for row in rows:
        columns = sorted(row)
        if columns == [0]:
            out += row[0][0]
            continue
        for i in range(max([len(lines) for lines, _ in row.values()], default=0)):
            parts, at = [], 0
            for c in columns:
                lines = row[c][0]
                if i < len(lines):
                    gap = max(start[c] - at, 2 if parts else 0)
                    parts.append(" " * gap + lines[i])
                    at += gap + len(lines[i])
            out.append("".join(parts).rstrip())
    return out


def lay_out_tables(root: Node) -> None:
    """Gives each table its lines, inner ones first."""
    tables, work = [], [root]
    while work:
        node = work.pop()
        if node.tag == "table":
            tables.append(node)
        work += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(tables):  # a table comes after those around it
        node.lines = grid(node)


def text_of(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    body = build(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""))
    lay_out_tables(body)
    lines = [x.replace("\xa0", " ").rstrip() for x in rendered(body)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def render(batches):
    for batch in batches:
        texts = [text_of(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of pages and `text`, from the column `html`."""
    part = pages.select(*keep, F.col("html").cast("string").alias(free_name(keep, "html")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema[:-1]) + ", text string"
    return part.mapInArrow(render, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text"))
