"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules and a renderer.

The tree builder closes and opens what HTML leaves out (paragraphs, list items, table rows and cells,
options, head and body) and never fails: unknown, misnested or unclosed tags have a defined place.
What the element's kind, a hidden attribute or the cascade of style sheets and style attributes hides is left
out; all other text is kept.  The cascade knows importance, specificity and order, and selectors of one element
(type, classes, id); rules of other selectors and of media but the screen do not hide.  Blocks begin on lines of
their own, paragraphs are set apart by a blank line, list items get markers and indents, and the cells of a table
are aligned in columns: every cell begins in its column, on the next line where one before it is too long.

Results that are defined: a null or empty page gives an empty text; nesting beyond 300 elements is
flattened, as browsers do; repeated rows give equal results; the time for a page of any length grows in
proportion to it; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField

from quern.llm.common import map_text, narrow

DEPTH = 300
#: A column is as wide as its widest line, but no wider than this; longer lines run on, and what follows goes below.
PAD = 60

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe noembed noframes object audio video canvas svg math meter progress rp".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr html legend li "
    "listing main nav optgroup option search section summary tr caption thead tbody tfoot".split()
)
CLOSES_P = BLOCKS - frozenset("body html option optgroup tr thead tbody tfoot caption legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
SCOPE = frozenset("table td th caption html button".split())
#: A start tag closes an open element of the first set unless one of the second lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile("[{};\"']")
_ENDS = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}", re.DOTALL) for q in "\"'"}
_SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")
_MARK = re.compile(r"[.#][\w-]+")
_PROPERTIES = frozenset(("display", "visibility", "white-space"))


class Node:
    __slots__ = ("children", "name", "attributes")

    def __init__(self, name: str, attributes: str = "") -> None:
        self.name, self.attributes, self.children = name, attributes, []

    def values(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attributes):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return found


def _tag_end(text: str, at: int) -> int:
    """Place behind the > of the tag; quoted values may hold one."""
    first = text.find(">", at)
    while m := _STOP.search(text, at):
        if m[0] == ">":
            return m.end()
        before = m.start() - 1
        while before >= at and text[before].isspace():
            before -= 1
        close = text.find(m[0], m.end()) if before >= at and text[before] == "=" else m.start()
        if close < 0:
            return first + 1 if first >= 0 else len(text)
        at = close + 1
    return first + 1 if first >= 0 else len(text)


def tokens(text: str):
    """('text', s), ('open', name, attributes) and ('close', name, '')."""
    at, size, low = 0, len(text), None
    while at < size:
        start = text.find("<", at)
        if start < 0:
            yield "text", text[at:], ""
            return
        if start > at:
            yield "text", text[at:start], ""
        if text.startswith("<!--", start):
            end = text.find("-->", start + 2 if text.startswith("<!-->", start) else start + 4)
            at = size if end < 0 else end + 3
        elif text.startswith("<![CDATA[", start):
            end = text.find("]]>", start)
            yield "text", html.escape(text[start + 9 : size if end < 0 else end]), ""
            at = size if end < 0 else end + 3
        elif m := _NAME.match(text, start):
            name = m[1].lower()
            stop = text.find(">", m.end())
            inner = text[m.end() : stop] if stop >= 0 else text[m.end() :]
            # Most tags hold no quoted ">"; an odd number of either quote says that this one may.
            at = stop + 1 if stop >= 0 and inner.count('"') % 2 == 0 and inner.count("'") % 2 == 0 else _tag_end(text, m.end())
            if text[start + 1] == "/":
                yield "close", name, ""
                continue
            yield "open", name, text[m.end() : at - 1 if text[at - 1] == ">" else at]
            if name == "plaintext":
                yield "text", html.escape(text[at:]), ""
                return
            if name in RAW:
                low = text.lower() if low is None else low
                if len(low) != size:  # a character that lower() makes longer
                    low = re.sub("[A-Z]", lambda c: c[0].lower(), text)
                end = low.find("</" + name, at)
                end = size if end < 0 else end
                body = text[at:end]
                yield "text", body if name in ("title", "textarea") else html.escape(body), ""
                yield "close", name, ""
                at = end if end == size else _tag_end(text, end + 2)
        elif text[start + 1 : start + 2] in ("!", "?", "/"):
            end = text.find(">", start)
            at = size if end < 0 else end + 1
        else:
            yield "text", "<", ""
            at = start + 1


def build(text: str) -> Node:
    root = Node("html")
    stack = [root]
    head_open = True

    def close_to(i: int) -> None:
        del stack[i:]

    def find(names, stops) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in stops:
                return 0
        return 0

    def push(name: str, attributes: str = "") -> None:
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name not in VOID:
            if len(stack) < DEPTH:
                stack.append(node)

    def body() -> None:
        nonlocal head_open
        if head_open:
            head_open = False
            if len(stack) > 1 and stack[1].name == "head":
                close_to(1)

    for kind, value, attributes in tokens(text):
        if kind == "text":
            inside = stack[-1].name
            if head_open and inside not in RAW and value.strip():
                body()
            stack[-1].children.append(html.unescape(value) if "&" in value else value)
        elif kind == "open":
            name = "img" if value == "image" else value
            if name == "html":
                root.attributes += " " + attributes
                continue
            if name == "head":
                if head_open and len(stack) == 1:
                    push(name, attributes)
                continue
            if name == "body":
                body()
                continue
            if name not in HEAD_ONLY:
                body()
            if name in CLOSES_P and (i := find({"p"}, SCOPE)):
                close_to(i)
            if name in HEADINGS and stack[-1].name in HEADINGS:
                stack.pop()
            if name in IMPLIED and (i := find(*IMPLIED[name])):
                close_to(i)
            if name in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                i = find({"table"}, set())
                if not i:
                    continue  # a cell outside any table: its text stays where it is
                if name in ("td", "th"):
                    if not find({"tr"}, {"table"}):
                        close_to(max(find({"thead", "tbody", "tfoot"}, {"table"}), i) + 1)
                        push("tr")
                    else:
                        close_to(find({"tr"}, {"table"}) + 1)
                elif name == "tr":
                    close_to(max(find({"thead", "tbody", "tfoot"}, {"table"}), i) + 1)
                else:
                    close_to(i + 1)
            if name == "a" and (i := find({"a"}, SCOPE)):
                close_to(i) if i == len(stack) - 1 else None
            push(name, attributes)
        else:
            name = value
            if name in ("html", "body", "head"):
                if name == "head":
                    body()
                continue
            if name == "br":
                push("br")
                continue
            stops = {"table"} if name in ("td", "th", "tr", "thead", "tbody", "tfoot") else set() if name == "table" else SCOPE - {name}
            if i := find(HEADINGS if name in HEADINGS else {name}, stops):
                close_to(i)
            elif name == "p":
                push("p")
                stack.pop()
    return root


def _uncommented(css: str) -> str:
    out, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        out.append(css[at:start])
        end = css.find("*/", start + 2)
        at = len(css) if end < 0 else end + 2
    return " ".join([*out, css[at:]])


def _on_screen(rule: str) -> bool:
    """Whether an at-rule's block holds for any screen."""
    name, _, rest = rule.lower().partition(" ")
    if name == "@media" or rule.lower().startswith("@media("):
        return any(q.strip() in ("", "all", "screen", "only screen", "only all") for q in rest.split(",")) and name == "@media"
    return name == "@layer" or name == "@supports" and "not" not in rest


def rules(css: str):
    """(selectors, declarations) of the blocks that hold on a screen, in order, by one pass."""
    css = _uncommented(css)
    at = scan = 0
    open_: list[tuple[str, bool]] = []  # text before each brace, and whether its block holds
    while m := _CSS.search(css, scan):
        scan, sign = m.end(), m[0]
        if sign in _ENDS:
            # A string that is not closed ends with its line.
            end = _ENDS[sign].match(css, scan)
            line = css.find("\n", scan)
            scan = end.end() if end else len(css) if line < 0 else line + 1
        elif sign == "{":
            head = css[at : m.start()].strip()
            holds = not open_ or open_[-1][1]
            open_.append((head, holds and (_on_screen(head) if head.startswith("@") else True)))
            at = scan
        elif sign == "}":
            if open_:
                head, holds = open_.pop()
                if holds and not head.startswith("@"):
                    yield head, css[at : m.start()]
            at = scan
        elif not open_ or open_[-1][0].startswith("@"):
            at = scan  # a statement such as @import


def declared(block: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of the properties that hide text or keep its blanks."""
    found: dict[str, tuple[bool, str]] = {}
    for part in block.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in _PROPERTIES:
            value, _, mark = value.lower().partition("!")
            important = mark.strip() == "important"
            if name not in found or important >= found[name][0]:
                found[name] = (important, value.strip())
    return found


class Sheet:
    """Rules of simple selectors, by a mark, type or ``*`` that an element must have.

    Rules of equal selectors are folded into one, and each stands under the mark that the fewest rules need, so that an
    element meets few beside those that hold for it; elements of equal type and marks are worked out once.
    """

    def __init__(self, root: Node) -> None:
        self.size = 0
        folded: dict[tuple[str, frozenset], dict[str, tuple]] = {}
        todo = [root]
        while todo:
            node = todo.pop()
            if node.name == "style" and _on_screen("@media " + node.values().get("media", "")):
                self._add("".join(c for c in node.children if isinstance(c, str)), folded)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]  # sheets in document order
        needs = Counter(mark for _, marks in folded for mark in marks)
        self.rules: dict[str, list[tuple]] = {}
        for (tag, marks), own in folded.items():
            key = min(marks, key=lambda m: (needs[m], m)) if marks else tag or "*"
            self.rules.setdefault(key, []).append((tag, marks, own))
        self.known: dict[tuple[str, frozenset], dict[str, tuple]] = {}

    def _add(self, css: str, folded: dict) -> None:
        for selectors, block in rules(css):
            if not (own := declared(block)):
                continue
            for selector in selectors.split(","):
                s = _SELECTOR.fullmatch(selector.strip())
                if not s or not s[0]:
                    continue
                marks = _MARK.findall(s[2])
                tag = "" if s[1] in (None, "*") else s[1].lower()
                ids = sum(m[0] == "#" for m in marks)
                self.size += 1
                rank = (0, ids, len(marks) - ids, bool(tag), self.size)
                _put(folded.setdefault((tag, frozenset(marks)), {}), own, rank)

    def _of(self, name: str, marks: frozenset) -> dict[str, tuple]:
        """Values that the rules give to elements of a type and marks, with what they won by."""
        if (name, marks) not in self.known:
            found: dict[str, tuple] = {}
            for key in (*marks, name, "*"):
                for tag, need, own in self.rules.get(key, ()):
                    if (not tag or tag == name) and need <= marks:
                        for c, won in own.items():
                            if c not in found or won[0] >= found[c][0]:
                                found[c] = won
            self.known[name, marks] = found
        return self.known[name, marks]

    def style(self, node: Node, values: dict[str, str]) -> dict[str, str]:
        """The winning values of an element."""
        found: dict[str, tuple] = {}
        if self.rules:
            marks = {"." + c for c in values.get("class", "").split()}
            if "id" in values:
                marks.add("#" + values["id"])
            found = dict(self._of(node.name, frozenset(marks)))
        if "style" in values:
            _put(found, declared(values["style"]), (1,))
        return {name: value for name, (_, value) in found.items()}


def _put(found: dict[str, tuple], own: dict[str, tuple[bool, str]], rank: tuple) -> None:
    """Values of a rule over those of weaker ones: important ones first, then by rank."""
    for name, (important, value) in own.items():
        if name not in found or (important, rank) >= found[name][0]:
            found[name] = ((important, rank), value)


class Writer:
    """Lines with collapsed white space and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a collapsed blank that waits
        self.due = 0  # line breaks before the next text
        self.prefix = ""
        self.marker = ""

    def breaks(self, n: int) -> None:
        self._end()
        self.due = max(self.due, n)

    def newline(self) -> None:
        if not self.line and not self.lines and not self.marker:
            return
        if self.line or self.marker:
            self._end()
        else:
            self.due = max(self.due, 1) + 1
        self.due = max(self.due, 1)

    def _end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def _begin(self) -> None:
        if not self.line:
            if self.lines and self.due > 1:
                self.lines.append("")
            self.due = 0
            self.line.append(self.prefix + self.marker)
            self.prefix, self.marker = self.prefix + " " * len(self.marker), ""

    def text(self, s: str) -> None:
        parts = _SPACE.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        for i, word in enumerate(parts):
            if not word:
                continue
            if i:
                self.space = True
            if not self.line:
                self._begin()
            elif self.space:
                self.line.append(" ")
            self.space = False
            self.line.append(word)
        if len(parts) > 1 and parts[-1] == "":
            self.space = True

    def verbatim(self, s: str) -> None:
        for i, row in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self._begin()
                self._end()
            if row:
                if not self.line:
                    self._begin()
                self.line.append(row)

    def rows(self, rows: list[str]) -> None:
        for row in rows:
            self._begin()
            self.line.append(row)
            self._end()

    def result(self) -> list[str]:
        self._end()
        return self.lines


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in s)


def _number(values: dict[str, str], name: str) -> int:
    digits = re.match(r"\s*(\d{1,4})", values.get(name, ""))
    return min(max(1, int(digits[1])), 1000) if digits else 1


class Renderer:
    def __init__(self, root: Node) -> None:
        self.sheet = Sheet(root)

    def render(self, node: Node, shown: bool = True, as_is: bool = False) -> list[str]:
        writer = Writer()
        for child in node.children:
            self.walk(child, writer, shown, as_is, 0)
        return writer.result()

    def state(self, node: Node, values: dict[str, str], shown: bool, as_is: bool) -> tuple[bool, bool, bool]:
        """Whether the element is not displayed, whether its own text is visible, and whether its blanks are kept."""
        if node.name in HIDDEN:
            return True, False, as_is
        if not values and not self.sheet.rules:
            return node.name == "dialog", shown, as_is
        own = self.sheet.style(node, values)
        display, space = own.get("display", "revert"), own.get("white-space", "")
        gone = display == "none" or display == "revert" and ("hidden" in values or node.name == "dialog" and "open" not in values)
        shown = {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(own.get("visibility", ""), shown)
        return gone, shown, space.startswith(("pre", "break-spaces")) or as_is and space not in ("normal", "nowrap", "initial")

    def walk(self, node, out: Writer, shown: bool, as_is: bool, depth: int) -> None:
        if isinstance(node, str):
            if shown:
                out.verbatim(node) if as_is else out.text(node)
            return
        name = node.name
        values = node.values() if node.attributes else {}
        gone, shown, as_is = self.state(node, values, shown, as_is)
        if gone:
            return
        if name == "br":
            out.newline()
            return
        if name == "hr":
            out.breaks(1)
            return
        if name == "input":
            if shown and values.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel") and values.get("value"):
                out.text(" " + values["value"] + " ")
            return
        if name == "table":
            self.table(node, out, shown, as_is, depth)
            return
        children = node.children
        if name == "details" and "open" not in values:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        gap = 0 if name in ("ul", "ol", "menu") and depth else 2 if name in PARAGRAPHS else 1 if name in BLOCKS else 0
        if name in ("ul", "ol", "menu") and depth:
            gap = 1
        if gap:
            out.breaks(gap)
        prefix, marker = out.prefix, out.marker
        if name in ("ul", "ol", "menu", "dir"):
            number = int(values["start"]) if re.fullmatch(r"-?\d{1,9}", values.get("start", "")) else 1
            for child in children:
                if isinstance(child, Node) and child.name == "li":
                    if name == "ol":
                        if re.fullmatch(r"-?\d{1,9}", own := child.values().get("value", "")):
                            number = int(own)
                        mark = f"{number}. "
                        number += 1
                    else:
                        mark = "- "
                    out.breaks(1)
                    before = out.prefix
                    out.marker = out.marker + mark if out.marker else mark
                    self.walk(child, out, shown, as_is, depth + 1)
                    out._end()
                    out.prefix, out.marker = before, ""
                    out.breaks(1)
                else:
                    self.walk(child, out, shown, as_is, depth)
        else:
            if name in ("blockquote", "dd"):
                out.prefix += "  "
            inner = as_is or name in ("pre", "listing", "textarea", "xmp")
            if inner and not as_is and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            for child in children:
                self.walk(child, out, shown, inner, depth)
        if gap:
            out._end()
            # A list item keeps the hanging indent that its marker set; its list takes it back.
            out.prefix = out.prefix if name == "li" else prefix
            if name != "li":
                out.marker = marker if out.marker else ""
            out.breaks(gap)

    def table(self, node: Node, out: Writer, shown: bool, as_is: bool, depth: int) -> None:
        """Cells in a grid, each column as wide as its widest line up to PAD."""
        out.breaks(2)
        rows: list[list[tuple[list[str], int, int]]] = []

        def visit(parent: Node, seen: bool, kept: bool) -> None:
            for child in parent.children:
                if isinstance(child, str):
                    if seen and child.strip():
                        out.text(child)
                    continue
                if child.name not in ("thead", "tbody", "tfoot", "tr", "col", "colgroup"):
                    self.walk(child, out, seen, kept, depth)  # captions and what is out of place
                    continue
                gone, now, same = self.state(child, child.values() if child.attributes else {}, seen, kept)
                if gone:
                    continue
                if child.name in ("thead", "tbody", "tfoot"):
                    visit(child, now, same)
                elif child.name == "tr":
                    row = []
                    for cell in child.children:
                        if not isinstance(cell, Node):
                            if now and cell.strip():
                                row.append(([" ".join(cell.split())], 1, 1))
                            continue
                        own = cell.values() if cell.attributes else {}
                        gone, visible, kept_cell = self.state(cell, own, now, same)
                        if not gone:
                            row.append((self.render(cell, visible, kept_cell), _number(own, "colspan"), _number(own, "rowspan")))
                    rows.append(row)

        visit(node, shown, as_is)
        out.breaks(1)
        grid: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}  # column: rows that a cell above still covers
        for row in rows:
            line: dict[int, list[str]] = {}
            column = 0
            fresh: dict[int, int] = {}
            for lines, wide, high in row:
                while taken.get(column, 0):
                    column += 1
                line[column] = lines
                for c in range(column, column + wide):
                    if high > 1:
                        fresh[c] = high - 1
                column += wide
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | fresh
            grid.append(line)
        widths: dict[int, int] = {}
        for line in grid:
            for c, lines in line.items():
                widths[c] = min(PAD, max([widths.get(c, 0), *map(_width, lines)]))
        starts: dict[int, int] = {}
        place = 0
        for c in sorted(c for c, w in widths.items() if w):
            starts[c] = place
            place += widths[c] + 2
        for line in grid:
            cells = [(starts[c], line[c]) for c in starts if c in line]
            for i in range(max([0, *(len(lines) for _, lines in cells)])):
                made, end = [], 0
                for start, lines in cells:
                    if i < len(lines) and lines[i]:
                        if made and start < end + 2:  # a line longer than its column
                            out.rows(["".join(made)])
                            made, end = [], 0
                        made.append(" " * (start - end) + lines[i])
                        end = start + _width(lines[i])
                if made:
                    out.rows(["".join(made).rstrip()])
        out.breaks(2)


def page_text(page: str) -> str:
    root = build(page)
    return "\n".join(Renderer(root).render(root)).strip("\n")


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: its id and the visible text of the page."""
    pages = narrow(df, id_col, html_col)

    def compute(column: pa.Array) -> list[pa.Array]:
        return [pa.array([page_text(p or "") for p in column.to_pylist()], pa.string())]

    return map_text(pages, ["doc_id"], "text", compute, [StructField("visible", StringType())]).selectExpr(f"doc_id AS `{id_col}`", "visible AS text")
