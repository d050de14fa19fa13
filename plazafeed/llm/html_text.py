"""All visible text of a page, laid out: block spacing, lists and aligned table cells.

A stack of open elements takes the page tag by tag: some start tags close others (a block
closes a paragraph, ``li`` closes ``li``, a cell closes the cell before), void elements have
no content. What is not displayed emits nothing, what is invisible emits none of its own
text but that of visible elements inside it. Text runs into lines, lines into blocks; the
cells of a table, which may span rows and columns and hold lines and tables of their own,
are laid out once its last row is known. Where each name is open is kept by name, so a tag costs
the same at any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Fixed values of HTML: elements without content, with raw content, never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas object desc metadata defs symbol".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure fieldset details hr".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav search section summary caption tr option".split())
#: A start tag closes these open elements, looked for up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "body": ({"head"}, set()),
    **{t: ({"thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]")
#: To the end of a tag: quotes open a value only after "=", and one that nothing closes is a character like others.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)|=)*+>")
NEXT = re.compile("[^>]*>")
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"[ \t\n\f\r]+")
DISPLAY = re.compile(r"display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Style sheets: comments, at-rules with what they hold, rules, selectors without combinators.
SHEET = re.compile(r"<style\b[^>]*>(.*?)</style\s*>", re.I | re.S)
WHOLE = re.compile(r"-?[0-9]{1,9}")
COMMENT = re.compile(r"/\*.*?\*/", re.S)
AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
MARK = re.compile(r"[.#][\w-]+")
#: Columns over which spans are kept; characters of a line within which a column has a place of its own.
COLUMNS, PLACES = 256, 256
#: Rows that a cell without an end spans.
ENDLESS = 1 << 30


class _Flow:
    """Lines under construction: of the page, or of one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.split("\n")
            self._add(first)
            for x in more:
                self._end()
                self._add(x)
            return
        words = BLANKS.sub(" ", s)
        if words != " " and words:
            if (self.space or words[0] == " ") and self.line and not self.line[-1].endswith(" "):
                words = " " + words.lstrip(" ")
            elif not self.line or self.line[-1].endswith(" "):
                words = words.lstrip(" ")
            self._add(words.rstrip(" "))
        self.space = words.endswith(" ") or (self.space and not words)

    def _add(self, s: str) -> None:
        if s:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.line.append(s)

    def _end(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def mark(self, s: str) -> None:
        self._add(s)
        self.space = False

    def block(self, gap: int) -> None:
        if self.line:
            self._end()
        self.space = False
        self.gap = max(self.gap, gap)

    def br(self) -> None:
        self._end()

    def whole(self) -> str:
        if self.line:
            self._end()
        return "\n".join(self.lines).strip("\n")


def _columns(rows: list[list[tuple[int, list[str]]]]) -> list[str]:
    """Rows of (column, lines) as lines, every column as wide as its widest line and two blanks apart; a row is as high as its highest cell.

    A column that begins beyond ``PLACES`` characters has no place: its cells stand two blanks after the cell before.
    """
    widths: dict[int, int] = {}
    for r in rows:
        for c, lines in r:
            widths[c] = max(widths.get(c, 0), max(map(len, lines)))
    start, at = {}, 0
    for c in sorted(widths):
        start[c] = 2 * c + at
        at += widths[c]
    out = []
    for r in rows:
        made: list[list[str]] = [[] for _ in range(max((len(lines) for _, lines in r), default=0))]
        length = [0] * len(made)
        for c, lines in r:
            for k, line in enumerate(lines):
                if line:
                    blanks = max(0, start[c] - length[k]) if start[c] <= PLACES else 2 if length[k] else 0
                    made[k] += [" " * blanks, line]
                    length[k] += blanks + len(line)
        out += ["".join(x).rstrip(" ") for x in made]
    return out


class _Table:
    """Rows of (column, lines). ``spans``: of columns that a cell of a row above takes, the last row it does.

    Spans are kept for the first ``COLUMNS`` columns, so that a row never costs more than these beside its own cells.
    """

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.spans: dict[int, int] = {}
        self.span, self.column = (1, 1), 0

    def row(self) -> None:
        self.rows.append([])
        self.column = 0

    def cell(self, columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.column < COLUMNS and self.spans.get(self.column, 0) >= len(self.rows):
            self.column += 1
        self.span = columns, rows

    def fill(self, lines: list[str]) -> None:
        columns, rows = self.span
        if rows > 1:
            last = len(self.rows) + rows - 1
            self.spans.update((c, last) for c in range(self.column, min(self.column + columns, COLUMNS)))
        if lines:
            self.rows[-1].append((self.column, lines))
        self.column += columns


class _Rules:
    """What style sheets say of display and visibility, for selectors of a name, classes and ids."""

    def __init__(self, sheets: list[str]) -> None:
        self.by_key: dict[str, list[tuple]] = {}
        for order, (selectors, body) in enumerate(m for s in sheets for m in RULE.findall(AT_RULE.sub(" ", COMMENT.sub(" ", s)))):
            hides, shown = DISPLAY.findall(body), VISIBILITY.findall(body)
            if not hides and not shown:
                continue
            for selector in selectors.split(","):
                if m := SELECTOR.fullmatch(selector.strip()):
                    marks = MARK.findall(m[2])
                    weight = sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), bool(m[1]), order
                    rule = weight, (m[1] or "").lower(), frozenset(marks), hides[-1].lower() == "none" if hides else None, shown[-1].lower() == "visible" if shown else None
                    self.by_key.setdefault(marks[0] if marks else rule[1], []).append(rule)

    def of(self, name: str, given: dict[str, str]) -> tuple[bool | None, bool | None]:
        """Hidden, visible: by the heaviest rule that says, the later of equal ones; None where none does."""
        own = {f".{c}" for c in (given.get("class") or "").split()} | ({f"#{given['id']}"} if given.get("id") else set())
        fit = sorted((r for k in (name, *own) for r in self.by_key.get(k, ()) if r[1] in ("", name) and r[2] <= own), key=lambda r: r[0])
        said = lambda k: next((r[k] for r in reversed(fit) if r[k] is not None), None)
        return said(3), said(4)


def _number(given: dict[str, str], name: str, most: int) -> int:
    n = given.get(name, "1").strip()
    return min(int(n), most) if n.isascii() and n.isdecimal() and len(n) < 10 else 1


class Page:
    """The tree builder's state for one page."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool]] = []  # name, not displayed by itself, visible
        self.places: dict[str, list[int]] = {}  # of each name the places in open
        self.flows: list[_Flow] = [_Flow()]
        self.tables: list[_Table] = []
        self.lists: list[list[int] | None] = []  # of a numbered list the last number and the step
        self.rules = None
        self.selects: list[tuple[bool, list[tuple[bool, str]]]] = []
        self.hidden = self.pre = 0

    def render(self, html: str) -> str:
        at, n = 0, len(html)
        if "<style" in html or "<STYLE" in html:
            self.rules = _Rules(SHEET.findall(html))
        while at < n:
            m = TAG.search(html, at)
            self.text(html[at : m.start() if m else n])
            if m is None:
                break
            if m[0] == "<!--":
                end = html.find("-->", m.end())
                at = n if end < 0 else end + 3
                continue
            rest = REST.match(html, m.end()) if m[2] else NEXT.match(html, m.end())
            rest = rest or NEXT.match(html, m.end())
            if rest is None:  # the page ends inside a tag
                break
            at, name = rest.end(), (m[2] or "").lower()
            if m[1]:
                self.end(name)
            elif name:
                self.start(name, html[m.end() : at - 1])
                if name in RAW:
                    stop = RAW[name].search(html, at)
                    if name == "textarea":
                        self.text(html[at : stop.start() if stop else n])
                    at = stop.start() if stop else n
        while self.open:
            self.pop()
        return self.flows[0].whole()

    def seen(self) -> bool:
        return not self.hidden and (not self.open or self.open[-1][2])

    def text(self, s: str) -> None:
        if s and self.seen():
            self.flows[-1].text(unescape(s) if "&" in s else s, self.pre > 0)

    def start(self, name: str, attrs: str) -> None:
        if name in BLOCK and name != "option":
            self.close({"p"}, {"table", "td", "th", "li", "button", "caption"})
        if name in CLOSES:
            self.close(*CLOSES[name])
        given = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs.strip() else {}
        style = given.get("style", "")
        hides, shown = (DISPLAY.findall(style), VISIBILITY.findall(style)) if style else ([], [])
        ruled = self.rules.of(name, given) if self.rules else (None, None)
        by_itself = "hidden" in given or (name == "dialog" and "open" not in given)
        unseen = name in UNSEEN or (hides[-1].lower() == "none" if hides else by_itself if ruled[0] is None else ruled[0])
        visible = shown[-1].lower() == "visible" if shown else ruled[1] if ruled[1] is not None else not self.open or self.open[-1][2]
        if name in VOID:
            if not (self.hidden or unseen) and visible:
                self.void(name, given)
            return
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, unseen, visible))
        self.hidden += unseen
        if self.hidden:
            return
        flow = self.flows[-1]
        if name in BLOCK and not (name == "option" and self.selects):
            flow.block(2 if name in PARAGRAPH and not (name in ("ul", "ol") and self.lists) else 1)
        if name == "pre":
            self.pre += 1
        elif name in ("ul", "ol", "menu"):
            step = -1 if "reversed" in given and WHOLE.fullmatch(given.get("start", "")) else 1
            self.lists.append([(int(given["start"]) if WHOLE.fullmatch(given.get("start", "")) else 1) - step, step] if name == "ol" else None)
        elif name == "li":
            count = self.lists[-1] if self.lists else None
            if count is not None:
                count[0] = int(given["value"]) if WHOLE.fullmatch(given.get("value", "")) else count[0] + count[1]
            if visible:
                flow.mark("  " * min(len(self.lists) - 1, 20) + (f"{count[0]}. " if count is not None else "- "))
        elif name == "table":
            self.tables.append(_Table())
        elif name == "tr" and self.tables:
            self.tables[-1].row()
        elif name in ("td", "th") and self.tables:
            self.tables[-1].cell(max(_number(given, "colspan", 1000), 1), _number(given, "rowspan", 65534) or ENDLESS)
            self.flows.append(_Flow())
        elif name == "select":
            self.selects.append(("multiple" in given or _number(given, "size", 1000) > 1, []))
        elif name == "option" and self.selects:
            self.selects[-1][1].append(("selected" in given, ""))
            self.flows.append(_Flow())

    def void(self, name: str, given: dict[str, str]) -> None:
        if name == "br":
            self.flows[-1].br()
        elif name == "hr":
            self.flows[-1].block(2)
        elif name == "img" and given.get("alt"):
            self.text(given["alt"])
        elif name == "input" and given.get("type", "").lower() in ("submit", "button", "reset", "text", "search", "email", "") and given.get("value"):
            self.text(given["value"])

    def close(self, names: set[str], up_to: set[str]) -> None:
        """Close the nearest of ``names`` and what is open inside it, unless one of ``up_to`` lies between."""
        last = lambda some: max((p[-1] for n in some if (p := self.places.get(n))), default=-1)
        k = last(names)
        if k > last(up_to) or (k >= 0 and k == last(up_to)):
            while len(self.open) > k:
                self.pop()

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        else:
            self.close({name}, {"table"} if name in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else {"td", "th"} if name != "table" else set())

    def pop(self) -> None:
        name, unseen, _ = self.open.pop()
        self.places[name].pop()
        shown = not self.hidden
        self.hidden -= unseen
        if not shown:
            return
        if name in ("td", "th") and self.tables:
            lines = self.flows.pop().whole().split("\n")
            self.tables[-1].fill([x for x in lines if x.strip()])
        elif name == "table" and self.tables:
            flow = self.flows[-1]
            flow.block(2)
            table = self.tables.pop()
            for line in _columns(table.rows):
                if line:
                    flow.mark(line)
                    flow.block(1)
        elif name == "option" and self.selects:
            text, options = self.flows.pop().whole(), self.selects[-1][1]
            options[-1] = options[-1][0], text
        elif name == "select" and self.selects:
            every, options = self.selects.pop()
            chosen = options if every else [o for o in options if o[0]][-1:] or options[:1]
            for _, text in chosen:
                self.flows[-1].text(f" {text} ", False)
        if name == "pre":
            self.pre -= 1
        elif name in ("ul", "ol", "menu"):
            self.lists.pop()
        if name in BLOCK and not (name == "option" and self.selects):
            self.flows[-1].block(2 if name in PARAGRAPH and not (name in ("ul", "ol") and self.lists) else 1)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages``; a null or empty html gives an empty text.

    Never raises on broken markup: unknown end tags are ignored, open elements are closed
    at the end, a tag that the page ends in is dropped. Repeated rows and null ids stay;
    a page of any length is rendered whole. A table's columns have places
    within the first ``PLACES`` characters of a line, whatever the table's size, and spans reach over the first
    ``COLUMNS`` columns, so that neither text nor time grows faster than the page. Style
    sheets count with their selectors of a name, classes and ids; an ``ol`` counts down where
    it is reversed and says from where, and a ``li`` may set its number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page().render(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", text_or_empty("html").alias("html")).mapInArrow(run, "page_id long, url string, text string")
