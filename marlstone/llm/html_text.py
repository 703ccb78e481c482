"""Visible text of HTML pages, laid out as a plain-text browser would.

A tree builder supplies tags that the markup implies (ends of p, li, dt, dd,
tr, td, option; tbody and tr in tables), then all text that visibility rules
leave is rendered: blocks on lines of their own, paragraphs apart by a blank
line, lists with marks and indents (up to ``MOST_INDENT`` columns), table
cells aligned in columns, tables within tables likewise.  Text in a table that
is in no cell comes before its rows.

Visibility follows the tags that are never shown, the attribute ``hidden``,
closed ``details`` and ``dialog``, inline styles, and the rules for ``display``
and ``visibility`` in style sheets of the page, by importance, specificity and
order: selectors of tags, ids and classes, below or right below each other.
Selectors with attributes, states or siblings, and sheets for other media than
screens, are left out.  What is visible inside something hidden is shown; what
is inside something that isn't displayed is not.

Null and empty pages have empty texts.  Broken markup never raises: a tag
without an end is text.  Very long pages and any depth of tags or tables are
taken whole, in time that grows with their length.  Repeated rows are rendered
each, a page_id may be null, further columns, whatever their names, are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.durable import released

_MARK = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>)""", re.S)
_LOOSE = re.compile(r"<(?P<data>(?!))?(?:/(?P<end>[a-zA-Z][^\s/>]*)[^>]*|(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>[^>]*)|[!?][^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_SCREEN = re.compile(r"^\s*@(?:supports|layer|media(?!\s+not\b)(?:(?!\b(?:print|speech)\b)[^{])*)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
NEVER_SEEN = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas svg datalist rp".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCKS = APART | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main menu nav option optgroup search section summary tr caption tbody thead tfoot".split())
ENDS_P = BLOCKS - frozenset("body html option optgroup tr caption tbody thead tfoot dd dt li legend figcaption".split()) | frozenset("dd dt li".split())
#: What a start tag ends, and what stops the search for it.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
#: What may stand in a head; anything else ends it.
HEADISH = frozenset("title meta link script style base noscript template bgsound".split())
_SCOPE = frozenset(("table", "td", "th", "caption", "html"))
#: Columns up to which nested blocks are indented.
MOST_INDENT = 64


class Node:
    __slots__ = ("attributes", "children", "parent", "shown", "tag", "visible")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None) -> None:
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent
        self.shown = self.visible = True


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def tree(source: str) -> Node:
    root = Node("html", {})
    path = [root]
    #: where in the path each tag is open
    places: dict[str, list[int]] = {}

    def last(tags: set[str] | frozenset) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def leave(tags: set[str] | frozenset, stop: set[str] | frozenset) -> bool:
        at = last(tags)
        if not at or at < last(stop):
            return False
        while len(path) > at:
            places[path.pop().tag].pop()
        return True

    def pop() -> None:
        places[path.pop().tag].pop()

    def enter(tag: str, attributes: dict[str, str]) -> Node:
        node = Node(tag, attributes, path[-1])
        path[-1].children.append(node)
        places.setdefault(tag, []).append(len(path))
        path.append(node)
        return node

    at, end, mark = 0, len(source), _MARK
    while at < end:
        start = source.find("<", at)
        if start < 0:
            start = end
        if start > at:
            if path[-1].tag == "head" and not source[at:start].isspace():
                pop()
            path[-1].children.append(html.unescape(source[at:start]))
        if start == end:
            break
        got = mark.match(source, start)
        if got is None and mark is _MARK and source[start + 1 : start + 2].isalpha():
            # a quote without an end: from here on tags end at the first ">"
            mark = _LOOSE
            got = mark.match(source, start)
        if got is None:
            path[-1].children.append("<")
            at = start + 1
            continue
        at = got.end()
        data, tag, closed = got["data"], got["tag"], got["end"]
        if data:
            path[-1].children.append(data)
        elif tag:
            tag = tag.lower()
            if path[-1].tag == "head" and tag not in HEADISH:
                pop()
            if tag in ENDS_P:
                leave({"p"}, _SCOPE | {"button"})
            if tag in IMPLIED_END:
                leave(*IMPLIED_END[tag])
            if tag in ("td", "th") and path[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if path[-1].tag == "table":
                    enter("tbody", {})
                enter("tr", {})
            elif tag == "tr" and path[-1].tag == "table":
                enter("tbody", {})
            attributes = attributes_of(got["attributes"]) if got["attributes"].strip(" \t\r\n\f/") else {}
            if tag in ("html", "body"):
                root.attributes.update(attributes)
                continue
            node = enter(tag, attributes)
            if tag in VOID:
                pop()
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                inner = source[at : stop.start() if stop else end]
                node.children.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
                pop()
                at = stop.end() if stop else end
        elif closed:
            closed = closed.lower()
            if closed == "br":
                path[-1].children.append(Node("br", {}, path[-1]))
            elif closed == "p":
                if not leave({"p"}, _SCOPE):
                    path[-1].children.append(Node("p", {}, path[-1]))
            elif closed not in ("html", "body"):
                leave({closed}, {"table"} if closed in ("td", "th", "tr", "tbody", "thead", "tfoot") else _SCOPE if closed != "table" else frozenset())
    return root


def _blocks(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet for screens, in order."""
    todo = [re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)]
    while todo:
        sheet = todo.pop()
        at = 0
        while (start := sheet.find("{", at)) >= 0:
            head = sheet[at:start].rpartition(";")[2].strip()
            if head.startswith("@"):
                depth, end = 1, len(sheet)
                for got in re.compile(r"[{}]").finditer(sheet, start + 1):
                    depth += 1 if got[0] == "{" else -1
                    if not depth:
                        end = got.start()
                        break
                if _SCREEN.fullmatch(head):
                    # what follows comes after what is inside
                    todo.append(sheet[end + 1 :])
                    sheet, at = sheet[start + 1 : end], 0
                    continue
            else:
                end = sheet.find("}", start)
                end = len(sheet) if end < 0 else end
                yield head, sheet[start + 1 : end]
            at = end + 1


class Styles:
    """Rules for display and visibility, matched from the root down.

    A node has the steps of selectors that end at it and, of its ancestors,
    all that have ended above, so a selector costs the same at any depth.
    """

    def __init__(self, sheets: list[str]) -> None:
        #: by a tag, id or class of the step: (step, names of it, step before it, whether right above, rule)
        self.steps: dict[str, list[tuple]] = {}
        order = n = 0
        for sheet in sheets:
            for selectors, declared in _blocks(sheet):
                found = _DECLARED.findall(declared)
                for selector in selectors.split(",") if found else ():
                    parts = selector.replace(">", " > ").split()
                    steps, above = [], False
                    for part in parts:
                        if part == ">":
                            above = True
                            continue
                        got = _COMPOUND.fullmatch(part)
                        if not got:
                            break
                        names = ([got[1].lower()] if got[1] and got[1] != "*" else []) + re.findall(r"[.#][\w-]+", got[2])
                        steps.append((names, above))
                        above = False
                    else:
                        order += 1
                        weight = (sum(x[0] == "#" for names, _ in steps for x in names), sum(x[0] == "." for names, _ in steps for x in names), sum(x[0] not in "#." for names, _ in steps for x in names), order)
                        rules = [(name.lower(), value.lower(), (bool(mark), *weight)) for name, value, mark in found]
                        before = None
                        for k, (names, right_above) in enumerate(steps):
                            n += 1
                            self.steps.setdefault(names[-1] if names else "*", []).append((n, frozenset(names), before, right_above, rules if k == len(steps) - 1 else None))
                            before = n

    def at(self, node: Node, above: frozenset, parent: frozenset) -> tuple[dict[str, str], frozenset]:
        """What the node's style says, and the steps that end here."""
        inline = node.attributes.get("style")
        if not self.steps and not inline:
            return {}, frozenset()
        best: dict[str, tuple] = {}
        names = {node.tag, *(f".{c}" for c in node.attributes.get("class", "").split())}
        if node.attributes.get("id"):
            names.add("#" + node.attributes["id"])
        ended = set()
        for name in (*names, "*") if self.steps else ():
            for step, own, before, right_above, rules in self.steps.get(name, ()):
                if own <= names and (before is None or before in (parent if right_above else above)):
                    ended.add(step)
                    for what, value, weight in rules or ():
                        best[what] = max(best.get(what, ((),)), (weight, value))
        for what, value, mark in _DECLARED.findall(inline or ""):
            key = what.lower()
            best[key] = max(best.get(key, ((),)), ((bool(mark), 1 << 30), value.lower()))
        return {what: found[1] for what, found in best.items()}, frozenset(ended)


def _sheets(root: Node) -> list[str]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style" and not re.search(r"\b(?:print|speech)\b|^\s*not\b", node.attributes.get("media", ""), re.I):
            found += [c for c in node.children if isinstance(c, str)]
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def decide(root: Node) -> None:
    """Sets what is displayed, and what of that is visible."""
    styles = Styles(_sheets(root))
    none: frozenset = frozenset()
    todo = [(root, none, none)]
    while todo:
        node, above, of_parent = todo.pop()
        parent = node.parent
        style, ended = styles.at(node, above, of_parent)
        display = style.get("display", "none" if "hidden" in node.attributes else "")
        closed = node.tag == "dialog" and "open" not in node.attributes or parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary"
        node.shown = node.tag not in NEVER_SEEN and display != "none" and not closed
        inherited = parent is None or parent.visible
        visibility = style.get("visibility", "inherit")
        node.visible = visibility == "visible" or visibility not in ("hidden", "collapse") and inherited
        if node.shown:
            below = above | ended if ended else above
            todo += [(c, below, ended) for c in node.children if isinstance(c, Node)]


class Layout:
    """Lines of text; blocks ask for a line end or for a blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = ""
        self.mark = ""
        self.gap = False
        self.apart = False

    def flush(self) -> None:
        text = "".join(self.line).strip(" ")
        self.line, self.gap = [], False
        if text:
            self.put(text)

    def put(self, text: str) -> None:
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = False
        lead = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
        self.mark = ""
        self.lines.append((lead + text).rstrip(" "))

    def words(self, text: str) -> None:
        parts = _BLANK.split(text)
        if len(parts) > 1 and not parts[0]:
            self.gap = True
        body = " ".join(p for p in parts if p)
        if body:
            self.line.append(" " + body if self.gap and self.line else body)
            self.gap = not parts[-1]
        elif len(parts) > 1:
            self.gap = True

    def kept(self, text: str) -> None:
        head, *rest = text.expandtabs(8).replace("\r\n", "\n").split("\n")
        self.line.append(head)
        for more in rest:
            got = "".join(self.line)
            self.line = [more]
            if got.strip():
                self.put(got.rstrip(" "))
            elif self.lines and not self.apart:
                self.lines.append("")

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def _rows(table: Node) -> tuple[list[list[Node]], list[Node]]:
    """Cells by row, and what is in no cell, to be shown before the rows."""
    rows, loose, todo = [], [], [(table, iter(table.children))]
    while todo:
        node, children = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            if child.strip():
                loose.append(Node("div", {}, node))
                loose[-1].children.append(child)
                loose[-1].visible = node.visible
        elif not child.shown:
            continue
        elif node.tag == "tr" and child.tag in ("td", "th"):
            rows[-1].append(child)
        elif child.tag in ("tr", "tbody", "thead", "tfoot", "colgroup") and node.tag != "tr":
            if child.tag == "tr":
                rows.append([])
            todo.append((child, iter(child.children)))
        else:
            loose.append(child)
    return rows, loose


def _table(table: Node, layout: Layout) -> Iterator:
    """Rows whose cells start at the same places; a cell may have lines."""
    rows, loose = _rows(table)
    for child in loose:
        layout.flush()
        yield _render([child], layout)
        layout.flush()
    cells = []
    for row in rows:
        line: list[list[str]] = []
        for cell in row:
            inner = Layout()
            yield _render(cell.children, inner, cell)
            line.append([x for x in inner.text().split("\n") if x] or [""])
            span = cell.attributes.get("colspan", "1")
            line += [[""]] * (min(int(span), 1000) - 1 if span.isascii() and span.isdigit() and len(span) < 5 else 0)
        cells.append(line)
    widths = [0] * max(map(len, cells), default=0)
    for line in cells:
        for k, cell in enumerate(line):
            widths[k] = max(widths[k], *map(len, cell))
    for line in cells:
        for shown in zip_longest(*line, fillvalue=""):
            text = "  ".join(x.ljust(w) for x, w in zip(shown, widths)).rstrip(" ")
            if text.strip():
                layout.put(text)


def _render(nodes: list, layout: Layout, parent: Node | None = None) -> Iterator:
    """Puts ``nodes`` into ``layout``; yields what has to be rendered between."""
    todo: list = [(node, parent) for node in reversed(nodes)]
    pre = 0
    while todo:
        item, above = todo.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            if above is None or above.visible:
                layout.kept(item) if pre else layout.words(item)
            continue
        if not item.shown:
            continue
        tag, children, above = item.tag, item.children, item.parent
        if tag == "br":
            if layout.line:
                layout.flush()
            elif layout.lines and not layout.apart:
                layout.apart = True
            continue
        if tag == "table":
            layout.flush()
            layout.apart = True
            yield _table(item, layout)
            layout.apart = True
            continue
        if tag in ("td", "th"):
            layout.gap = True
        if tag in BLOCKS:
            layout.flush()
            apart = tag in APART and not (tag in ("ul", "ol") and above is not None and above.tag == "li")
            layout.apart |= apart
            was, width = layout.indent, 0
            if tag == "li":
                ordered = above is not None and above.tag == "ol"
                if ordered:
                    start = above.attributes.get("start", "1")
                    first = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
                    number = above.attributes.setdefault(" next", str(first))
                    above.attributes[" next"] = str(int(number) + 1)
                layout.mark = f"{number}. " if ordered else "- "
                width = len(layout.mark)
            elif tag in ("blockquote", "dd"):
                width = 4
            if len(was) < MOST_INDENT:
                layout.indent += " " * width
            pre += tag == "pre"

            def leave(was: str = was, tag: str = tag, apart: bool = apart) -> None:
                nonlocal pre
                layout.flush()
                layout.indent, layout.mark = was, ""
                pre -= tag == "pre"
                layout.apart |= apart

            todo.append((leave, None))
        todo += [(child, item) for child in reversed(children)]


def render(root: Node, layout: Layout) -> None:
    """The whole tree, without recursion, however deep tables are nested."""
    running = [_render([root], layout)]
    while running:
        inner = next(running[-1], None)
        if inner is None:
            running.pop()
        else:
            running.append(inner)


def extract(source: str | None) -> tuple[str, str]:
    """Title and visible text."""
    root = tree(source or "")
    title, todo = "", [root]
    while todo and not title:
        node = todo.pop()
        if node.tag == "title":
            title = _BLANK.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip(" ")
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in ("svg", "template")]
    decide(root)
    layout = Layout()
    render(root, layout)
    return title, layout.text()


def render_pages(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """``key``, title, text, and n_chars of the text, per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            titles, texts = [], []
            for page in batch.column(1).to_pylist():
                title, text = extract(page)
                titles.append(title)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["k", "title", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(source).alias("h")).mapInArrow(run, f"k {kind}, title string, text string, n_chars long").withColumnRenamed("k", key)
