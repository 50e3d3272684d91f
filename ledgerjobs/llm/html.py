"""HTML extraction: a tree of boxes, which of them are visible, and their text laid out in lines."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements by how they are treated.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp plaintext".split())
UNSEEN = frozenset("head script style noscript template iframe noembed noframes title datalist area base link meta param source track object audio video canvas rp desc defs metadata symbol clippath annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table caption tbody thead tfoot tr td th ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl figure ol ul pre listing xmp plaintext table hr fieldset menu dir".split())
PREFORMATTED = frozenset("pre listing textarea xmp plaintext".split())
#: Levels of indentation: trees of browsers are no deeper.
DEEPEST = 512
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS, ROWS, GROUPS = frozenset("td th".split()), frozenset(["tr"]), frozenset("tbody thead tfoot".split())
TABLE_PARTS = CELLS | ROWS | GROUPS | {"caption", "table"}
IN_HEAD = frozenset("base basefont bgsound link meta title script noscript style template noframes head html body".split())
CLOSES_P = BLOCK - CELLS - ROWS - GROUPS - frozenset("body html caption legend option optgroup summary".split())
P_SCOPE = ("table", "td", "th", "caption", "button", "object", "marquee", "foreignobject")
LEAVES_GRAPHICS = BLOCK | frozenset("b big br code em i img s small span strike strong sub sup tt u var".split())
# what an opening tag ends, and where the search for it stops
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    **{cell: (("td", "th", "caption"), ("tr", "table")) for cell in CELLS},
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    **{group: (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)) for group in GROUPS},
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
}
KEPT = frozenset("id class style hidden start value type size colspan rowspan selected multiple open".split())
UNWRITTEN = frozenset("hidden password checkbox radio file image range color".split())

PLAIN_END = re.compile(r"\s*>")
BETWEEN, SPACES = re.compile(r"[\s/]*"), re.compile(r"\s*")
TAG_NAME, NAME, UNQUOTED = re.compile(r"[A-Za-z][^\s/>]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*")
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
HUGE_NUMBER = re.compile(r"&#[0-9]{8,};?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
SIMPLE = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][A-Za-z_-][\w-]*)*)")


class Box:
    """An element: its parts (strings and boxes), kept attributes, and what is worked out about it."""

    __slots__ = ("tag", "parts", "attributes", "gone", "shown", "grid", "lines")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.parts, self.attributes = tag, [], attributes or {}
        self.gone, self.shown, self.grid, self.lines = False, True, None, None

    def number(self, name: str, default: int) -> int:
        value = self.attributes.get(name, "").strip()
        return int(value) if re.fullmatch(r"[+-]?[0-9]{1,9}", value) else default


def unescaped(text: str) -> str:
    return html.unescape(HUGE_NUMBER.sub("�", text)) if "&" in text else text


class _Reader:
    """The source, read once from left to right; what is not found is not searched for again."""

    def __init__(self, source: str):
        self.source, self.end, self.missing = source, len(source), set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def after(self, what: str, at: int) -> int:
        found = self.find(what, at)
        return self.end if found < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """The attributes from ``at`` on, whether a slash ends the tag, and the place behind it; -1 if the tag does not end.

        A quote counts where a value begins; one that is never closed ends with the tag.
        """
        source, out = self.source, {}
        if m := PLAIN_END.match(source, at):
            return out, False, m.end()
        while True:
            at = BETWEEN.match(source, at).end()
            if at >= self.end:
                return out, False, -1
            if source[at] == ">":
                return out, source[at - 1] == "/", at + 1
            m = NAME.match(source, at)
            name, value = m.group().lower(), ""
            at = SPACES.match(source, m.end()).end()
            if source.startswith("=", at):
                at = SPACES.match(source, at + 1).end()
                quote = source[at : at + 1]
                if quote and quote in "\"'":
                    close = self.find(quote, at + 1)
                    stop = close if close >= 0 else self.find(">", at + 1)
                    if stop < 0:
                        return out, False, -1
                    value, at = source[at + 1 : stop], stop + (close >= 0)
                else:
                    m = UNQUOTED.match(source, at)
                    value, at = m.group(), m.end()
            if name in KEPT and name not in out:
                out[name] = unescaped(value)


class _Stack:
    """Open elements, and where in the stack those of each name are."""

    def __init__(self, root: Box):
        self.boxes, self.at = [root], defaultdict(list, {root.tag: [0]})

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def first_after(self, place: int, tags) -> int | None:
        found = [self.at[t][i] for t in tags if (i := bisect_right(self.at[t], place)) < len(self.at[t])]
        return min(found, default=None)

    def push(self, box: Box) -> None:
        self.at[box.tag].append(len(self.boxes))
        self.boxes.append(box)

    def cut(self, place: int | None) -> None:
        if place is not None and place > 0:
            while len(self.boxes) > place:
                self.at[self.boxes.pop().tag].pop()


def build_tree(source: str) -> tuple[Box, list[str]]:
    """The tree of ``source`` and the style sheets in it: implied end tags, void and raw elements, stray end tags dropped, open ones closed at the end."""
    root, styles, read = Box("html"), [], _Reader(source)
    stack, at = _Stack(root), 0
    while at < read.end:
        begin = read.find("<", at)
        text = source[at : begin if begin >= 0 else read.end]
        if text:
            if stack.at["head"] and text.strip():
                stack.cut(stack.last("head"))
            stack.boxes[-1].parts.append(unescaped(text))
        if begin < 0:
            break
        sign = source[begin + 1 : begin + 2]
        if source.startswith("<!--", begin):
            at = read.after("-->", begin + 2)
        elif sign and sign in "!?":
            at = read.after(">", begin)
        elif sign == "/":
            m = TAG_NAME.match(source, begin + 2)
            if not m:
                at = read.after(">", begin) if begin + 2 < read.end else read.end
                continue
            _, _, at = read.attributes(m.end())
            at = at if at >= 0 else read.end
            _close(stack, m.group().lower())
        elif m := TAG_NAME.match(source, begin + 1):
            tag = m.group().lower()
            attributes, slash, at = read.attributes(m.end())
            if at < 0:
                break
            box = _open(stack, tag, attributes, slash)
            if box is not None and tag in RAW:
                close = None if tag == "plaintext" else CLOSING[tag].search(source, at)
                body = source[at : close.start() if close else read.end]
                at = read.after(">", close.end()) if close else read.end
                if tag == "style":
                    styles.append(body)
                elif tag not in UNSEEN:
                    box.parts.append(unescaped(body) if tag == "textarea" else body)
        else:
            stack.boxes[-1].parts.append("<")
            at = begin + 1
    return root, styles


def _open(stack: _Stack, tag: str, attributes: dict[str, str], slash: bool) -> Box | None:
    """The new box where the standard puts it; None if it has nothing to be read as raw text."""
    if tag in ("html", "body") and stack.at[tag]:
        return None
    if stack.at["head"] and (tag not in IN_HEAD or tag == "body"):
        stack.cut(stack.last("head"))
    graphics = stack.last("svg", "math")
    if graphics > 0 and tag in LEAVES_GRAPHICS and graphics > stack.last("foreignobject"):
        stack.cut(graphics)
        graphics = -1
    if tag in IMPLIED:
        ends, stops = IMPLIED[tag]
        stack.cut(stack.first_after(stack.last(*stops), ends))
    if tag in CLOSES_P and stack.last("p") > stack.last(*P_SCOPE):
        stack.cut(stack.last("p"))
    if tag in HEADINGS and stack.boxes[-1].tag in HEADINGS:
        stack.cut(len(stack.boxes) - 1)
    box = Box(tag, attributes)
    stack.boxes[-1].parts.append(box)
    if tag in VOID or (slash and graphics > 0):
        return None
    if tag not in RAW:
        stack.push(box)
    return box


def _close(stack: _Stack, tag: str) -> None:
    if tag == "br" or (tag == "p" and stack.last("p") <= stack.last(*P_SCOPE)):
        stack.boxes[-1].parts.append(Box(tag))
        return
    place = stack.last(*HEADINGS) if tag in HEADINGS else stack.last(tag)
    wall = stack.last("table") if tag in TABLE_PARTS else stack.last("table", "td", "th", "caption")
    if place >= wall:
        stack.cut(place)


def declarations(body: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of ``display`` and ``visibility`` in a list of declarations; the last counts, an important one more."""
    out: dict[str, tuple[bool, str]] = {}
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value, mark, _ = value.lower().partition("!")
            if (mark == "!") >= out.get(name, (False, ""))[0]:
                out[name] = (mark == "!", value.strip())
    return out


class _Styles:
    """Rules of simple selectors (a name, ids and classes); others and those in at-rules are passed over."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, dict[tuple, dict]] = defaultdict(dict)
        for order, (selector, body) in enumerate(r for sheet in sheets for r in self._blocks(re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S))):
            if not (said := declarations(body)):
                continue
            for one in selector.split(","):
                m = SIMPLE.fullmatch(one.strip())
                if not m or not m.group():
                    continue
                name = (m[1] or "*").lower()
                marks = frozenset(re.findall(r"[.#][^.#]+", m[2]))
                ids = sum(x[0] == "#" for x in marks)
                first = min(marks, default=name)
                known = self.rules[first].setdefault((name, marks), {})
                for prop, (important, value) in said.items():
                    known[prop] = max(known.get(prop, ()), (important, 0, ids, len(marks) - ids, int(name != "*"), order, value))

    @staticmethod
    def _blocks(css: str) -> Iterator[tuple[str, str]]:
        at = 0
        while (begin := css.find("{", at)) >= 0:
            selector = css[at:begin].rpartition(";")[2].strip()
            if selector.startswith("@"):
                depth, at = 1, len(css)
                for m in re.compile("[{}]").finditer(css, begin + 1):
                    depth += 1 if m.group() == "{" else -1
                    if not depth:
                        at = m.end()
                        break
                continue
            end = css.find("}", begin)
            end = end if end >= 0 else len(css)
            yield selector, css[begin + 1 : end]
            at = end + 1

    def of(self, box: Box) -> dict[str, str]:
        """What the rules and the box's own style say about ``display`` and ``visibility``."""
        own = box.attributes.get("style")
        best = {p: (important, 1, 0, 0, 0, 0, v) for p, (important, v) in declarations(own).items()} if own else {}
        if self.rules:
            marks = {"." + c for c in box.attributes.get("class", "").split()}
            marks |= {"#" + box.attributes["id"]} if "id" in box.attributes else set()
            for key in (box.tag, "*", *sorted(marks)):
                for (name, needed), said in self.rules.get(key, {}).items():
                    if name in ("*", box.tag) and needed <= marks:
                        for prop, value in said.items():
                            best[prop] = max(best.get(prop, ()), value)
        return {p: v[-1] for p, v in best.items()}


def dress(root: Box, styles: list[str]) -> list[Box]:
    """Works out for each box if it is gone or hidden; returns the tables with columns, outer ones first."""
    rules, todo, tables = _Styles(styles), [root], []
    while todo:
        box = todo.pop()
        for part in box.parts:
            if isinstance(part, str) or part.gone:
                continue
            said = rules.of(part)
            unseen = "hidden" in part.attributes or part.tag == "dialog" and "open" not in part.attributes
            part.gone = part.tag in UNSEEN or said["display"] == "none" if "display" in said else part.tag in UNSEEN or unseen
            part.gone |= part.tag == "input" and part.attributes.get("type", "").lower() == "hidden"
            visibility = said.get("visibility", "inherit")
            part.shown = visibility not in ("hidden", "collapse") if visibility in ("visible", "hidden", "collapse") else box.shown
            if part.gone:
                continue
            if part.tag == "select":
                _choose(part)
            todo.append(part)
    # rows are gathered once all is known about their boxes
    todo = [root]
    while todo:
        box = todo.pop()
        if box.tag == "table":
            box.grid = _grid(box)
            if box.grid:
                tables.append(box)
        todo += [p for p in box.parts if not isinstance(p, str) and not p.gone]
    return tables


def _choose(select: Box) -> None:
    """Of a closed list only the chosen option is seen, in its line."""
    options = [o for p in select.parts if not isinstance(p, str) for o in ([p] if p.tag == "option" else p.parts) if not isinstance(o, str) and o.tag == "option"]
    if not options or "multiple" in select.attributes or select.number("size", 1) > 1:
        return
    chosen = [o for o in options if "selected" in o.attributes][-1:] or options[:1]
    for option in options:
        option.gone = option is not chosen[0]
    chosen[0].tag = "span"


def _grid(table: Box) -> tuple[list[list[Box]], list[Box]] | None:
    """Rows of cells, and what stands outside of them, of a table; None if no row has two cells."""
    rows, loose, holder = [], [], Box("div")
    stack = [(table, iter(table.parts), 1)]
    open_row = None
    while stack:
        box, parts, rank = stack[-1]
        for part in parts:
            if isinstance(part, str):
                holder.parts.append(part)
                continue
            if part.gone:
                continue
            if part.tag in CELLS:
                if box is not open_row:  # a cell without a row begins one
                    rows.append((rank, []))
                    open_row = box
                rows[-1][1].append(part)
            elif part.tag == "caption":
                loose.append(part)
            elif part.tag in ROWS or part.tag in GROUPS:
                inner = {"thead": 0, "tfoot": 2}.get(part.tag, rank)
                if part.tag in ROWS:
                    rows.append((inner, []))
                    open_row = part
                stack.append((part, iter(part.parts), inner))
                break
            else:
                holder.parts.append(part)
        else:
            stack.pop()
    if max((len(cells) for _, cells in rows), default=0) < 2:
        return None
    return [cells for _, cells in sorted(rows, key=lambda r: r[0]) if cells], [holder, *loose]


class _Page:
    """Lines of text under way: pending blank, pending line breaks, prefix of the line."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks = 0
        self.blank = False
        self.indent = ""
        self.mark = ""

    def block(self, breaks: int) -> None:
        self.blank = False
        self.breaks = max(self.breaks, breaks)

    def deeper(self) -> None:
        """Two more blanks; below ``DEEPEST`` levels no more, as browsers' trees end there."""
        self.indent += "  " if len(self.indent) < 2 * DEEPEST else ""

    def line(self) -> None:
        self.breaks += 1
        self.blank = False

    def _begin(self) -> bool:
        """Starts a line if one is due."""
        starts = bool(self.breaks) or not self.out
        if self.breaks and self.out:
            self.out.append("\n" * min(self.breaks, 2))
        if starts:
            self.out.append(self.indent + self.mark)
            self.mark = ""
        self.breaks = 0
        return starts

    def text(self, s: str, pre: bool) -> None:
        if pre:
            self.rows(s.replace("\r\n", "\n").split("\n"))
            return
        words = BLANKS.sub(" ", s)
        if words in ("", " "):
            self.blank |= words == " "
            return
        lead = words[0] == " " or self.blank
        if not self._begin() and lead:
            self.out.append(" ")
        self.out.append(words.strip(" "))
        self.blank = words[-1] == " "

    def rows(self, rows: list[str]) -> None:
        for i, row in enumerate(rows):
            if i:
                self.line()
            if row:
                self._begin()
                self.out.append(row)

    def lines(self) -> list[str]:
        rows = [row.rstrip() for row in "".join(self.out).split("\n")]
        while rows and not rows[-1]:
            rows.pop()
        first = next((i for i, row in enumerate(rows) if row), 0)
        return rows[first:]


class _Columns:
    """Which columns of a table are free in a row: as intervals, so that a row costs what its cells and the intervals beside them do."""

    def __init__(self):
        self.free: list[list] = [[0, math.inf]]
        self.held: list[tuple[float, int, int]] = []  # heap of (row from which on it is free, start, end) of cells that span rows
        self.tangled = False

    def row(self, y: int) -> None:
        """Cells that ended before row ``y`` set their columns free."""
        if not self.held or self.held[0][0] > y:
            return
        over = []
        while self.held and self.held[0][0] <= y:
            over.append(heappop(self.held)[1:])
        if self.tangled:  # cells lie over each other: what is still held is taken out of all
            self.free = [[0, math.inf]]
            self.take(sorted((a, b) for _, a, b in self.held))
            return
        for a, b in over:
            i = bisect_left(self.free, [a])
            if i < len(self.free) and self.free[i][0] == b:
                b = self.free.pop(i)[1]
            if i and self.free[i - 1][1] == a:
                self.free[i - 1][1] = b
            else:
                self.free.insert(i, [a, b])

    def take(self, held: list[tuple[int, int]]) -> None:
        for start, end in held:
            i = max(0, bisect_right(self.free, [start, math.inf]) - 1)
            while i < len(self.free) and self.free[i][0] < end:
                a, b = self.free[i]
                if b <= start:
                    i += 1
                    continue
                left = [[x, y] for x, y in ((a, min(b, start)), (max(a, end), b)) if x < y]
                self.free[i : i + 1] = left
                i += len(left) if b > end or not left else 1

    def place(self, cells: list[tuple[int, float]]) -> list[int]:
        """Columns of a row's cells (span, row from which on it is free, or 0 for this row alone), from left to right."""
        found, now, i, column = [], [], 0, 0
        for span, until in cells:
            while self.free[i][1] <= column:
                i += 1
            column = max(column, self.free[i][0])
            found.append(column)
            if until:
                self.tangled |= column + span > self.free[i][1]
                heappush(self.held, (until, column, column + span))
                now.append((column, column + span))
            column += span
        if now:
            self.take(now)
        return found


def lay_out(table: Box, widest: int | None) -> list[str]:
    """Lines of a table whose inner tables are laid out: columns aligned, spans kept, cells of several lines side by side.

    With ``widest``, columns are padded up to that many characters; longer cells push what follows to the right.
    Where blanks would be more than a hundred times the text, columns are not aligned: a page of
    some hundred kilobytes could otherwise ask for gigabytes of them.
    """
    rows, loose = table.grid
    out = [line for part in loose for line in render(part)]
    # places: (row, column, span, lines of the cell); a cell that spans rows keeps its columns in them
    taken, places = _Columns(), []
    most = sum(c.number("rowspan", 1) != 1 for r in rows for c in r) + max(map(len, rows))
    for y, row in enumerate(rows):
        taken.row(y)
        spans = [min(max(1, cell.number("colspan", 1)), 1000, most) for cell in row]
        down = [cell.number("rowspan", 1) for cell in row]
        until = [0 if n == 1 else y + n if 1 < n <= 65534 else math.inf for n in down]
        places.append([(column, span, render(cell)) for column, span, cell in zip(taken.place(list(zip(spans, until, strict=True))), spans, row, strict=True)])
    # only columns where a cell begins or ends count
    edges = sorted({e for row in places for c, s, _ in row for e in (c, c + s)})
    at = {e: i for i, e in enumerate(edges)}
    places = [[(at[c], at[c + s] - at[c], lines) for c, s, lines in row] for row in places]
    columns = max(c + s for row in places for c, s, _ in row)
    width = [0] * columns
    for wide in (False, True):
        for row in places:
            for column, span, lines in row:
                if (span > 1) == wide:
                    longest = max(map(len, lines), default=0)
                    need = (longest if widest is None else min(widest, longest)) - sum(width[column : column + span]) - 2 * (span - 1)
                    width[column + span - 1] += max(0, need)
    start = [0]
    for w in width:
        # a column without text takes no room
        start.append(start[-1] + (w + 2 if w else 0))
    blanks = sum(start[c] * len(lines) for row in places for c, _, lines in row[-1:])
    if blanks > 100 * (1000 + sum(len(line) for row in places for _, _, lines in row for line in lines)):
        start = [0] * len(start)
    for row in places:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for column, _, lines in row:
                if i < len(lines) and lines[i]:
                    line = (line + "  " if len(line) > start[column] - 2 and line else line).ljust(start[column]) + lines[i]
            out.append(line)
    return out


def render(root: Box) -> list[str]:
    """The lines of all visible text below ``root``, without recursion; tables with columns are laid out before."""
    page = _Page()
    # (box, its parts, what to restore at its end, pre, number of the next list item in a list of one)
    stack: list[tuple] = [(root, iter(root.parts), None, root.tag in PREFORMATTED, None)]
    while stack:
        box, parts, finish, pre, counter = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if box.shown:
                    page.text(part, pre)
                continue
            tag = part.tag
            if part.gone:
                continue
            if tag == "br":
                page.line()
                continue
            if tag == "input" and part.shown and part.attributes.get("type", "").lower() not in UNWRITTEN:
                page.text(part.attributes.get("value", ""), False)
            if tag == "hr":
                page.block(2)
            if tag in VOID:
                continue
            if part.lines is not None:
                page.block(2)
                page.rows(part.lines)
                page.block(2)
                continue
            inside = tag in LISTS and counter is not None
            gap = 1 if inside else 2 if tag in SPACED else 1 if tag in BLOCK else 0
            if gap:
                page.block(gap)
            undo, inner = (gap, page.indent, page.mark, tag), counter
            if tag in LISTS:
                inner = [part.number("start", 1) if tag == "ol" else None]
                if inside:
                    page.deeper()
            elif tag in ("table", "td", "th"):
                inner = None
            elif tag == "li":
                number = counter[0] if counter else None
                if number is not None:
                    number = part.number("value", number)
                    counter[0] = number + 1
                page.mark = "- " if number is None else f"{number}. "
            elif tag in ("dd", "blockquote"):
                page.deeper()
            stack.append((part, iter(part.parts), undo, pre or tag in PREFORMATTED, inner))
            break
        else:
            stack.pop()
            if finish:
                gap, indent, mark, tag = finish
                page.indent, page.mark = indent, "" if tag == "li" else page.mark and mark
                if gap:
                    page.block(gap)
    return page.lines()


def visible_text(source: str | None, widest: int | None = None) -> str:
    if not source:
        return ""
    root, styles = build_tree(source)
    for table in reversed(dress(root, styles)):
        table.lines = lay_out(table, widest)
    return "\n".join(render(root))


def extract_text(pages: DataFrame, *, page_id: str = "page_id", html_column: str = "html", widest: int | None = None) -> DataFrame:
    """(page_id, text, n_chars): the visible text of each row of ``pages``, laid out.

    Paragraphs, headings, lists and tables stand apart by a blank line, other blocks by a line
    break; list items carry ``-`` or their number and nested lists are indented. Columns of a
    table are aligned to their real width (``widest`` sets a limit if wanted), with spans of columns and rows and cells of
    several lines; a table of one column is a row of blocks. Left out is what a browser does
    not show: head, scripts, styles, templates, fallbacks of embedded media, options that are
    not chosen, closed dialogs, ``hidden``, and what ``display`` and ``visibility`` hide, in an
    element's style or by rules of a style sheet with simple selectors (name, class, id). Text
    of SVG and MathML, values of inputs and closed ``details`` are shown.

    Null and empty pages give empty texts; broken markup is read as far as it goes: a tag that
    does not end is dropped, a quote that is never closed ends with its tag. Reading is linear in
    the page and no depth of nesting makes it recurse. Repeated rows and null ids stay as they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [visible_text(s, widest) for s in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "text": texts, "n_chars": [len(t) for t in texts]})

    slim = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(html_column).cast("string").alias("html"))
    kind = dict(pages.dtypes)[page_id]
    return slim.mapInPandas(run, "page_id string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast(kind))
