"""The block structure of a markdown text, line by line: a stack of quotes and list items, and the leaf that is open in them."""

from __future__ import annotations

import re

# Tags that begin a block of raw HTML which a blank line ends, and those whose contents are raw.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
RAW_TAGS = "script pre style textarea".split()
ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
#: How a block of raw HTML begins and what ends it (None: a blank line); the last can't interrupt a paragraph.
HTML = [
    (re.compile(rf"<(?:{'|'.join(RAW_TAGS)})(?:[\s>]|$)", re.I), re.compile(rf"</(?:{'|'.join(RAW_TAGS)})>", re.I)),
    (re.compile("<!--"), re.compile("-->")), (re.compile(r"<\?"), re.compile(r"\?>")), (re.compile("<![A-Za-z]"), re.compile(">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(BLOCK_TAGS)})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
]
BULLET, RULE = re.compile(r"([-*+]|(\d{1,9})([.)]))(?=\s|$)"), re.compile(r"(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$")
ATX, FENCE, SETEXT = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"), re.compile(r"(`{3,})[^`]*$|(~{3,})"), re.compile(r"(=+|-+)[ \t]*$")
DEFINITION = re.compile(r"""\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""", re.S)
PLAIN_START = re.compile(r"[^\W\d_]")


def label(text: str) -> str:
    """What link labels are compared by."""
    return " ".join(text.split()).casefold()


class List:
    """kind: its bullet or delimiter. loose: blank lines stand between its items or between the blocks of one."""

    def __init__(self, kind: str) -> None:
        self.kind, self.loose = kind, False


class Item:
    """indent: columns that its lines begin with. filled: it has a block; blank: a blank line came last; over: it takes no more."""

    def __init__(self, of: List, indent: int) -> None:
        self.of, self.indent, self.filled, self.blank, self.over = of, indent, False, False, False


class Blocks:
    """events: ("heading", level, text, place), ("paragraph", text, list or None), ("code", text), ("end", item), in order;
    place is the number of the heading's first character. labels: those of link definitions."""

    def __init__(self, text: str) -> None:
        self.events, self.labels = [], set()
        self.stack: list[Item | None] = []  # None is a quote
        self.kind, self.lines, self.more = "", [], None  # of the open leaf; more: what its kind needs to know
        self.begins = at = 0
        for line in text.removesuffix("\n").split("\n"):
            self.at = at
            at += len(line) + 1
            self.line(line.removesuffix("\r"))
        self.close(0)

    @staticmethod
    def spread(rest: str, col: int) -> str:
        """The rest of a line from a column on, with the tabs before its text as spaces."""
        if "\t" not in rest:
            return rest
        text = rest.lstrip(" \t")
        start = col
        for c in rest[: len(rest) - len(text)]:
            col += 4 - col % 4 if c == "\t" else 1
        return " " * (col - start) + text

    def line(self, line: str) -> None:
        if not self.stack and self.kind in ("", "paragraph") and PLAIN_START.match(line):
            self.text(line)
            return
        rest, col, matched = self.spread(line, 0), 0, 0
        for c in self.stack:
            blank = not rest.strip()
            if c is None:
                indent = len(rest) - len(rest.lstrip(" "))
                if indent > 3 or rest[indent : indent + 1] != ">":
                    break
                rest, col = self.spread(rest[indent + 1 :], col + indent + 1), col + indent + 1
                if rest[:1] == " ":
                    rest, col = rest[1:], col + 1
            elif c.over or blank and not c.filled:
                c.over = True
                break
            elif not blank:
                if not rest.startswith(" " * c.indent):
                    break
                rest, col = rest[c.indent :], col + c.indent
            matched += 1
        whole = matched == len(self.stack)
        if whole and self.kind in ("fence", "html", "code") and self.goes_on(rest):
            return
        fresh = False
        while rest.strip():
            indent = len(rest) - len(rest.lstrip(" "))
            if indent > 3:
                break
            body = rest[indent:]
            in_paragraph = self.kind == "paragraph" and whole and not fresh
            if body[0] == ">":
                self.child(matched)
                self.stack.append(None)
                rest, col = self.spread(body[1:], col + indent + 1), col + indent + 1
                if rest[:1] == " ":
                    rest, col = rest[1:], col + 1
            elif (m := BULLET.match(body)) and not (RULE.match(body) or in_paragraph and SETEXT.match(body)) and not (in_paragraph and (not body[m.end() :].strip() or m[2] and int(m[2]) != 1)):
                kind = m[3] or m[1]
                before = self.stack[matched] if matched < len(self.stack) else None
                same = before.of if isinstance(before, Item) and before.of.kind == kind else None
                if same and before.blank:
                    same.loose = True
                self.child(matched, same is None)
                rest, col = self.spread(body[m.end() :], col + indent + m.end()), col + indent + m.end()
                gap = len(rest) - len(rest.lstrip(" "))
                gap = gap if rest.strip() and gap < 5 else 1
                rest, col = rest[gap:], col + gap
                self.stack.append(Item(same or List(kind), indent + m.end() + gap))
            else:
                break
            matched, whole, fresh = len(self.stack), True, True
        self.leaf(rest, matched, whole, fresh)

    def child(self, matched: int, direct: bool = True) -> None:
        """Another block begins in the container at `matched`: what is open below is closed; blank lines before it make a list loose."""
        self.close(matched)
        if matched and isinstance(item := self.stack[-1], Item):
            if direct and item.filled and item.blank:
                item.of.loose = True
            item.filled = True
        for c in self.stack:
            if c:
                c.blank = False

    def leaf(self, rest: str, matched: int, whole: bool, fresh: bool) -> None:
        body = rest.lstrip(" ")
        indent = len(rest) - len(body)
        open_paragraph = self.kind == "paragraph" and not fresh
        if not body.strip():
            self.end_leaf()
            quotes = [i for i, c in enumerate(self.stack) if c is None]
            if not whole and (gone := next((i for i in quotes if i >= matched), None)) is not None:
                self.close(gone)
            for c in self.stack[max([i + 1 for i in quotes if i < matched], default=0) :]:
                if c:
                    c.blank = c.blank or not fresh
            return
        if indent > 3:
            if open_paragraph:
                self.lines.append(body)
            else:
                self.child(matched)
                self.kind, self.lines, self.more = "code", [rest[4:]], 0
            return
        if m := FENCE.match(body):
            self.child(matched)
            self.kind, self.lines, self.more = "fence", [], (m[1] or m[2], indent)
        elif m := ATX.match(body):
            self.child(matched)
            self.events.append(("heading", len(m[1]), (m[2] or "").strip(), self.at))
        elif open_paragraph and whole and (m := SETEXT.match(body)) and (text := self.undefined()):
            self.events.append(("heading", 1 if m[1][0] == "=" else 2, text, self.begins))
            self.kind, self.lines = "", []
        elif RULE.match(body):
            self.child(matched)
        elif body[0] == "<" and (end := next(((e, i) for i, (b, e) in enumerate(HTML) if b.match(body) and not (i == len(HTML) - 1 and open_paragraph)), None)):
            self.child(matched)
            self.kind, self.more = "html", end[0]
            if self.more and self.more.search(body):
                self.kind = ""
        elif open_paragraph:
            self.lines.append(body)  # of the same container, or lazily of one that this line isn't in
        else:
            self.child(matched)
            self.text(body)

    def text(self, line: str) -> None:
        if self.kind != "paragraph":
            self.kind, self.lines, self.begins = "paragraph", [], self.at
        self.lines.append(line)

    def goes_on(self, rest: str) -> bool:
        """Whether the line belongs to the open code or raw HTML."""
        indent = len(rest) - len(rest.lstrip(" "))
        if self.kind == "fence":
            mark, by = self.more
            closing = rest.strip()
            if indent < 4 and closing and not closing.strip(mark[0]) and len(closing) >= len(mark):
                self.end_leaf()
            else:
                self.lines.append(rest[min(indent, by) :])
            return True
        if self.kind == "html":
            if self.more and self.more.search(rest) or not self.more and not rest.strip():
                self.kind = ""
                return bool(self.more)
            return True
        if rest.strip() and indent < 4:
            return False
        self.lines.append(rest[4:])
        if not rest.strip():
            for c in self.stack:
                if c:
                    c.blank = True
        return True

    def undefined(self) -> str:
        """The open paragraph without the link definitions it begins with, which are noted."""
        text = "\n".join(x.strip() for x in self.lines)
        while text.startswith("[") and (m := DEFINITION.match(text)) and m[1].strip():
            self.labels.add(label(m[1]))
            text = text[m.end() :]
        self.lines = [text]
        return text.strip()

    def end_leaf(self) -> None:
        if self.kind == "paragraph":
            if text := self.undefined():
                parent = self.stack[-1] if self.stack else None
                self.events.append(("paragraph", text, parent.of if parent else None))
        elif self.kind in ("fence", "code"):
            lines = self.lines
            while self.kind == "code" and lines and not lines[-1].strip():
                lines = lines[:-1]
            self.events.append(("code", "".join(x + "\n" for x in lines)))
        self.kind, self.lines, self.more = "", [], None

    def close(self, keep: int) -> None:
        """Closes the open leaf and the containers beyond the first `keep`."""
        self.end_leaf()
        while len(self.stack) > keep:
            if c := self.stack.pop():
                self.events.append(("end", c))
