"""Visible text of HTML pages, laid out.

A tokenizer reads tags, text, comments and raw-text elements; a tree builder adds implied tags (html, head, body,
table rows and bodies) and closes elements whose end tags may be left out. Elements that are never rendered, the
``hidden`` attribute, inline styles and the page's own style sheets decide what is visible: of the rules whose selector is one compound
of tag, classes and id the cascade is followed. A rule hides only where it holds on any screen; one under a condition, or of a selector
that is not evaluated, can only show (over rules of the sheets, not over inline styles), so no text is lost to it. The renderer lays out blocks on lines of their
own with a blank line around paragraphs and headings, lists with markers and indentation, preformatted text as it is,
and tables with padded columns.

Every step reads a page once: attributes are scanned without going back, open elements are counted by name, and elements stand
at most DEPTH deep (deeper ones become siblings, as in browsers), so time grows with the page whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.batches import slices

# Element kinds of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("textarea title".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
NEVER = frozenset("area audio base basefont canvas col colgroup datalist embed head iframe link meta noembed noframes object param rp script source style template title track video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table ul xmp".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul xmp dir".split())
LISTS = frozenset("ol ul menu dir".split())
PRE = frozenset("listing plaintext pre textarea xmp".split())
#: A start tag of these closes an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
#: A start tag (key) closes these if one is open, unless one of the elements after the bar stands above it.
IMPLIED = {
    "li": ("li", "ol ul menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "rt": ("rt rp", "ruby"),
    "rp": ("rt rp", "ruby"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tr": ("td th tr caption colgroup", "tbody thead tfoot table"),
    "tbody": ("td th tr tbody thead tfoot caption colgroup", "table"),
    "thead": ("td th tr tbody thead tfoot caption colgroup", "table"),
    "tfoot": ("td th tr tbody thead tfoot caption colgroup", "table"),
    "caption": ("td th tr tbody thead tfoot caption colgroup", "table"),
    "colgroup": ("colgroup caption", "table"),
    "a": ("a", "table td th"),
    "button": ("button", "form"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
SPACE = " \t\n\r\f"
TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>\x00]*)|([!?]|/(?=[^a-zA-Z])))")
#: The end of a tag, or an attribute and its value; nothing is matched at the end of the page.
ATTRIBUTE = re.compile(r"""[ \t\n\r\f/]*+(?:(>)|(=?[^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^ \t\n\r\f>]*+)))?+)""")
NUMBER = re.compile("&#[0-9]{8,}+;?")
#: Open elements at a time, the widest padding of a column and of a row before its last cell, and the widest indentation.
DEPTH, PAD, LINE, INDENT = 512, 120, 480, 64
FENCES = frozenset("button td th table caption object".split())
BLANKS = re.compile(f"[{SPACE}]+")
CSS = re.compile(r"([^{};]*)([{};]|$)")
COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")
NAMES = re.compile(r"([.#])([\w-]+)")
#: Not evaluated; a selector with a state that a page does not start in is not met.
COMPLEX = re.compile(r"[\s>+~:\[&]")
STATES = re.compile(r":(?:hover|focus|active|visited|target)", re.I)
HIDDEN = {"display": ("none",), "visibility": ("hidden", "collapse")}
#: Levels of the cascade.
SHEET, SHOWS, INLINE, IMPORTANT = 0, 1, 2, 3


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _unescape(text: str) -> str:
    if "&" not in text:
        return text
    return entities.unescape(NUMBER.sub("\ufffd", text) if "&#" in text else text)


def _tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag whose name ends at ``at``, and where it ends (-1: never).

    A quote that is never closed is a part of a name, so that no text is lost to it.
    """
    out: dict[str, str] = {}
    if page.startswith(">", at):
        return out, at + 1
    while True:
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1]:
            return out, at
        if not m[2]:
            return out, -1
        value = m[3] if m[3] is not None else m[4] if m[4] is not None else m[5] or ""
        out.setdefault(m[2].lower(), _unescape(value))


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page and the texts of its style elements."""
    root = Node("html", {})
    head, body = Node("head", {}), Node("body", {})
    root.children = [head, body]
    stack: list[Node] = [root, head]
    held: Counter[str] = Counter()  # open elements by name, below the head or body
    marks: list[int] = []  # where open paragraphs, and what shields them, stand
    styles: list[str] = []  # with their media

    def cut(i: int) -> None:
        for node in stack[i:]:
            held[node.name] -= 1
        del stack[i:]
        while marks and marks[-1] >= i:
            marks.pop()

    def in_body() -> None:
        if stack[1] is head:
            cut(2)
            stack[1:] = [body]

    def pop_until(names: frozenset[str], fence: frozenset[str]) -> None:
        """Close open elements of the given names, up to a fence."""
        if not any(held[name] for name in names):
            return
        last = None
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].name in fence:
                break
            if stack[i].name in names:
                last = i
        if last is not None:
            cut(last)

    def text(data: str) -> None:
        if not data:
            return
        if stack[1] is head and len(stack) == 2:
            if not data.strip(SPACE):
                return
            in_body()
        stack[-1].children.append(_unescape(data))

    def start(name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body", "head"):
            target = {"html": root, "body": body, "head": head}[name]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            if name == "body":
                in_body()
            return
        if stack[1] is head and name not in HEAD:
            in_body()
        if name in ENDS_P and marks and stack[marks[-1]].name == "p":
            cut(marks[-1])
        if name in IMPLIED:
            pop_until(*IMPLIED[name])
        parent = stack[-1].name
        if name in ("td", "th") and parent in ("table", "tbody", "thead", "tfoot"):
            if parent == "table":
                push("tbody", {})
            push("tr", {})
        elif name == "tr" and parent == "table":
            push("tbody", {})
        push(name, attrs)

    def push(name: str, attrs: dict[str, str]) -> None:
        if len(stack) >= DEPTH:
            cut(DEPTH - 1)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name not in VOID:
            if name == "p" or name in FENCES:
                marks.append(len(stack))
            stack.append(node)
            held[name] += 1

    def end(name: str) -> None:
        if name == "head":
            if stack[1] is head:
                in_body()
            return
        if name in ("html", "body"):
            return
        if name == "br":
            start("br", {})
            return
        if name == "p" and not held["p"]:
            in_body()
            push("p", {})
        if not held[name]:
            return
        fence = () if name in ("table", "html", "body") else ("table",) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("td", "th", "table", "caption")
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].name == name:
                cut(i)
                return
            if stack[i].name in fence:
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        if m[1]:
            if page.startswith((">", "->"), m.end()):
                at = page.index(">", m.end()) + 1
                continue
            stop = page.find("-->", m.end())
            at = n if stop < 0 else stop + 3
        elif m[3]:
            name = m[3].lower()
            attrs, at = _tag(page, m.end())
            if at < 0:  # a tag without an end is dropped with the rest of the page
                break
            if m[2]:
                end(name)
                continue
            if name in RAW or name in RCDATA:
                stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                data = page[at : stop.start()] if stop else page[at:]
                at = n if stop is None else stop.start()
                start(name, attrs)
                if name == "style":
                    styles.append(f"@media {attrs['media']}{{{data}}}" if attrs.get("media", "").strip() else data)
                if data and name != "script":
                    stack[-1].children.append(_unescape(data) if name in RCDATA else data)
            elif name == "plaintext":
                start(name, attrs)
                stack[-1].children.append(page[at:])
                break
            else:
                start(name, attrs)
        elif page.startswith("[CDATA[", m.end()):
            stop = page.find("]]>", m.end())
            at = n if stop < 0 else stop + 3
        else:
            stop = page.find(">", m.end())
            at = n if stop < 0 else stop + 1
    return root, styles


def declared(body: str) -> list[tuple[str, bool, bool]]:
    """(property, hides, important) of the declarations of display and visibility."""
    found = []
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in HIDDEN and value:
            found.append((name, value.split("!")[0].strip() in HIDDEN[name], "!" in value))
    return found


def applies(prelude: str) -> bool | None:
    """Whether the rules of an at-rule hold on a screen; None where that depends on more."""
    name, _, rest = prelude.partition(" ") if "(" not in prelude.split(" ")[0] else (prelude.split("(")[0], "", "(")
    if name == "@layer":
        return True
    if name != "@media":
        return None
    found = []
    for query in rest.split(","):
        q = " ".join(query.lower().split()).removeprefix("only ")
        if q in ("", "all", "screen", "not print", "not speech"):
            found.append(True)
        elif q in ("not all", "not screen") or re.match(r"(?:print|speech)\b", q):
            found.append(False)
        else:
            found.append(None)
    return True if True in found else None if None in found else False


def _without_comments(style: str) -> str:
    parts, at = [], 0
    while (begin := style.find("/*", at)) >= 0:
        parts.append(style[at:begin])
        stop = style.find("*/", begin + 2)
        at = len(style) if stop < 0 else stop + 2
    return "".join([*parts, style[at:]]).replace("<!--", "").replace("-->", "")


def sheet_rules(styles: list[str]) -> list[tuple[str, str, bool | None]]:
    """(selectors, declarations, whether the rule holds) of style rules in order, also of those within at-rules."""
    found = []
    for style in styles:
        stack: list[list] = []  # prelude, declarations, state
        for m in CSS.finditer(_without_comments(style)):
            text, end = m[1].strip(), m[2]
            if end == "{":
                outer = stack[-1] if stack else ["", [], True]
                if text.startswith("@"):
                    here = applies(text)
                    state = False if False in (here, outer[2]) else True if here and outer[2] else None
                    stack.append([outer[0], [], state])
                else:  # a nested rule is not evaluated
                    stack.append([f"& {text}" if outer[0] else text, [], outer[2]])
                continue
            if stack and text:
                stack[-1][1].append(text)
            if end == "}" and stack:
                selectors, body, state = stack.pop()
                if selectors and body:
                    found.append((selectors, ";".join(body), state))
        found += [(selectors, ";".join(body), state) for selectors, body, state in reversed(stack) if selectors and body]
    return found


def hiding_rules(styles: list[str]) -> dict[str, list[tuple]]:
    """By .class, #id, tag or * of a selector: (classes and ids, tag, property, rank, hides). Empty if nothing hides."""
    if not any(x in style.lower() for style in styles for x in ("none", "hidden", "collapse")):
        return {}
    rules: dict[str, list[tuple]] = {}
    any_hides = False
    for order, (selectors, body, state) in enumerate(sheet_rules(styles)):
        facts = declared(body)
        if state is False or not facts:
            continue
        for selector in selectors.split(","):
            selector = selector.strip()
            if not selector or STATES.search(selector):
                continue
            sure = state and not COMPLEX.search(selector)
            m = COMPOUND.match(re.split(r"[:\[]", re.split(r"[\s>+~&]+", selector)[-1])[0])
            if not m:
                continue
            names = NAMES.findall(m[2])
            tag = "" if m[1] in (None, "*") else m[1].lower()
            weight = (sum(k == "#" for k, _ in names), sum(k == "." for k, _ in names), bool(tag))
            key = "".join(names[-1]) if names else tag or "*"
            for name, hides, important in facts:
                if hides and not sure:
                    continue
                any_hides |= hides
                level = (SHEET if sure else SHOWS) + IMPORTANT * important
                rules.setdefault(key, []).append((frozenset("".join(n) for n in names), tag, name, (level, weight, order), hides))
    return rules if any_hides else {}


class Layout:
    """Collects lines: inline text with collapsed white space, blocks on lines of their own."""

    def __init__(self, rules: dict[str, list[tuple]]):
        self.rules = rules
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.space = False  # collapsed white space is due before the next word
        self.indent = ""
        self.marker = ""

    def hidden(self, node: Node) -> bool:
        a = node.attrs
        if node.name in NEVER:
            return True
        if node.name == "dialog" and "open" not in a:
            return True
        if "hidden" in a and a["hidden"].lower() != "until-found" or node.name == "input":
            return True
        best: dict[str, tuple] = {}
        if "style" in a:
            for i, (name, hides, important) in enumerate(declared(a["style"])):
                best[name] = max(best.get(name, ((-1,), False)), ((INLINE + IMPORTANT * important, (), i), hides))
        if self.rules:
            names = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())
            for key in ("*", node.name, *names):
                for needs, tag, name, rank, hides in self.rules.get(key, ()):
                    if tag in ("", node.name) and needs <= names:
                        best[name] = max(best.get(name, ((-1,), False)), (rank, hides))
        return any(hides for _, hides in best.values())

    def word(self, text: str) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.now.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def inline(self, text: str) -> None:
        if text[0] in SPACE:
            self.space = bool(self.now)
        body = text.strip(SPACE)
        if body:
            self.word(BLANKS.sub(" ", body))
            self.space = text[-1] in SPACE

    def newline(self, blank: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap |= blank

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                if self.now:
                    self.newline()
                elif self.lines and not self.gap:
                    self.lines.append("")
            if line:
                self.word(line.replace("\r", ""))

    def walk(self, node: Node, pre: bool = False) -> None:
        todo: list = [iter(node.children)]
        undo: list = [(None, pre)]
        while todo:  # explicit, since pages nest as deep as they like
            child = next(todo[-1], None)
            pre = undo[-1][1]
            if child is None:
                todo.pop()
                leave, _ = undo.pop()
                if leave:
                    leave()
            elif isinstance(child, str):
                self.verbatim(child) if pre else child and self.inline(child)
            elif self.hidden(child):
                continue
            elif child.name == "br":
                if self.now:
                    self.newline()
                elif self.lines:
                    self.gap = True
            elif child.name == "hr":
                self.newline(True)
            elif child.name == "table":
                self.newline(True)
                self.table(child)
                self.newline(True)
            elif child.name in BLOCK or child.name in ("tr", "td", "th", "tbody", "caption"):
                spaced = child.name in SPACED and not (child.name in LISTS and self.indent)
                self.newline(spaced)
                indent, marker, children = self.indent, self.marker, child.children
                if child.name in LISTS:
                    number = _number(child.attrs.get("start"), 1)
                    for item in child.children:
                        if isinstance(item, Node) and item.name == "li" and not self.hidden(item):
                            number = _number(item.attrs.get("value"), number)
                            item.attrs["\0marker"] = f"{number}. " if child.name == "ol" else "* "
                            number += 1
                elif child.name == "li":
                    mark = child.attrs.get("\0marker", "* ")
                    self.indent, self.marker = (indent + " " * len(mark))[: max(INDENT, len(mark))], mark
                elif child.name in ("dd", "blockquote"):
                    self.indent = (indent + "  ")[:INDENT]

                def leave(indent: str = indent, spaced: bool = spaced) -> None:
                    self.newline(spaced)
                    self.indent, self.marker = indent, ""

                todo.append(iter(children))
                undo.append((leave, pre or child.name in PRE))
            else:
                todo.append(iter(child.children))
                undo.append((None, pre or child.name in PRE))

    def table(self, node: Node) -> None:
        """Rows on lines, columns padded to their widest line (PAD at most, LINE in all); nested blocks in a cell give lines of the cell."""
        rows: list[dict[int, list[str]]] = []
        captions: list[Node] = []
        loose: list[Node] = []
        groups: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
        for part in node.children:
            if isinstance(part, str):
                if part.strip(SPACE):
                    loose.append(Node("div", {}))
                    loose[-1].children.append(part)
            elif not self.hidden(part):
                if part.name == "caption":
                    captions.append(part)
                elif part.name in groups:
                    groups[part.name].append(part)
                else:
                    loose.append(part)
        above: list[tuple[int, int, int]] = []  # first column, column after, last row of cells that reach down
        for part in (p for k in ("thead", "tbody", "tfoot") for p in groups[k]):
            for row in part.children:
                if isinstance(row, str) or row.name != "tr":
                    if isinstance(row, Node) and not self.hidden(row) or isinstance(row, str) and row.strip(SPACE):
                        loose.append(Node("div", {}))
                        loose[-1].children.append(row)
                    continue
                if self.hidden(row):
                    continue
                number, here, passed = len(rows), 0, 0
                above = [x for x in above if x[2] >= number]
                cells: dict[int, list[str]] = {}
                reach: list[tuple[int, int, int]] = []
                for cell in row.children:
                    if isinstance(cell, str):
                        if cell.strip(SPACE):
                            loose.append(Node("div", {}))
                            loose[-1].children.append(cell)
                        continue
                    if self.hidden(cell):
                        continue
                    while passed < len(above) and above[passed][0] <= here:
                        here = max(here, above[passed][1])
                        passed += 1
                    inner = Layout(self.rules)
                    inner.walk(cell)
                    if lines := inner.done():
                        cells[here] = lines
                    down = min(1000, max(1, _number(cell.attrs.get("rowspan"), 1)))
                    wide = min(1000, max(1, _number(cell.attrs.get("colspan"), 1)))
                    if down > 1:
                        reach.append((here, here + wide, number + down - 1))
                    here += wide
                if reach:
                    above = sorted(above + reach)
                rows.append(cells)
        for part in [*captions, *loose]:  # text outside cells comes before the table
            self.newline()
            self.walk(part)
            self.newline()
        width: dict[int, int] = {}
        for cells in rows:
            for i, cell in cells.items():
                width[i] = max(width.get(i, 0), max(map(len, cell)))
        place, end = {}, 0
        for i in sorted(i for i, w in width.items() if w):
            place[i] = min(end, LINE)
            end += min(width[i], PAD) + 2
        for cells in rows:
            for k in range(max(map(len, cells.values()), default=0)):
                line = ""
                for i, cell in cells.items():
                    if k < len(cell) and cell[k]:
                        line += " " * max(place[i] - len(line), 2 if line else 0) + cell[k]
                if line.strip():
                    self.word(line.rstrip())
                    self.newline()

    def done(self) -> list[str]:
        self.newline()
        return self.lines


def _number(text: str | None, default: int) -> int:
    m = re.match(r"\s*([-+]?[0-9]{1,9})", text or "")
    return int(m[1]) if m else default


def text_of(page: str | None) -> str | None:
    """The visible text of a page; null for null."""
    if page is None:
        return None
    root, styles = parse(page)
    layout = Layout(hiding_rules(styles))
    for node in root.children:
        if not layout.hidden(node) and not layout.hidden(root):
            layout.walk(node)
    return "\n".join(layout.done())


def extract(pages: DataFrame, *, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the visible text of each row in column ``to`` (which it replaces).

    Null pages give null, pages without visible text an empty text. Equal pages get equal texts. Malformed markup never
    fails: stray end tags are ignored, open elements end with the page, a tag that never ends is dropped, elements
    over DEPTH deep become siblings of the deepest, and a number that names no character becomes U+FFFD. Pages of any length are read whole.
    Columns of tables are padded to PAD characters, rows to LINE before a cell, and texts indented by INDENT at most; longer lines push aside what follows. Rows
    stay in their partition: no shuffle; other columns stay as they are; an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c != to]
    schema = T.StructType([T.StructField(c, pages.schema[c].dataType) for c in kept] + [T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html_col):
                text = [text_of(p) for p in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(text, pa.string())], [*kept, to])

    return pages.mapInArrow(run, schema)
