"""Chunking: sections by heading, packed to token targets, with an overlap from the part before."""

from __future__ import annotations

import bisect
import hashlib
import html
import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions.scalars import sentences, token_estimate
from quillmere.operators.blocks import Blocks, label


def estimate(s: str) -> int:
    return (len(s.encode()) + 3) // 4


SPECIAL = re.compile(r"[\\`<&*_!\[]")
LINK = re.compile(r"""!?\[((?:[^\[\]\\]|\\.)*)\]\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)""")
REFERENCE = re.compile(r"!?\[((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+)>")
TAG = re.compile(r"""</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|<!--(?:>|->|.*?-->)|<\?.*?\?>""", re.S)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


class Marks:
    """A run of * or _ and what is left of it; whether it can open or close emphasis follows from the characters beside it."""

    def __init__(self, mark: str, n: int, before: str, after: str) -> None:
        self.mark, self.left, self.n = mark, n, n
        space = [x.isspace() for x in (before, after)]
        sign = [unicodedata.category(x)[0] in "PS" for x in (before, after)]
        opens = not space[1] and (not sign[1] or space[0] or sign[0])
        closes = not space[0] and (not sign[0] or space[1] or sign[1])
        self.opens = opens and (mark == "*" or not closes or sign[0])
        self.closes = closes and (mark == "*" or not opens or sign[1])

    def pairs(self, closer: Marks) -> bool:
        both = self.closes or closer.opens
        return self.mark == closer.mark and not (both and (self.n + closer.n) % 3 == 0 and (self.n % 3 or closer.n % 3))


def inline(s: str, labels=frozenset()) -> str:
    """Visible text of a paragraph: no emphasis marks, code ticks, link or image targets, or raw tags; escapes and entities read.
    labels: those of the text's link definitions."""
    if not SPECIAL.search(s):
        return s
    out, runs, at = [], [], 0
    while at < len(s):
        m = SPECIAL.search(s, at)
        if not m:
            out.append(s[at:])
            break
        out.append(s[at : m.start()])
        at, c = m.start(), m[0]
        if c == "\\":
            follows = s[at + 1 : at + 2]
            escaped = bool(follows) and follows in string.punctuation + "\n"
            out.append(follows if escaped else c)
            at += 1 + escaped
        elif c == "`":
            n = re.compile("`+").match(s, at).end() - at
            end = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(s, at + n)
            code = s[at + n : end.start()].replace("\n", " ") if end else "`" * n
            out.append(code[1:-1] if end and code.strip() and code[0] == code[-1] == " " else code)
            at = end.end() if end else at + n
        elif c in "*_":
            n = re.compile(re.escape(c) + "+").match(s, at).end() - at
            runs.append(Marks(c, n, s[at - 1] if at else " ", s[at + n] if at + n < len(s) else " "))
            out.append(runs[-1])
            at += n
        elif c in "![" and (m := LINK.match(s, at)):
            out.append(inline(m[1], labels))
            at = m.end()
        elif labels and c in "![" and (m := REFERENCE.match(s, at)) and label(m[2] or m[1]) in labels:
            out.append(inline(m[1], labels))
            at = m.end()
        elif c == "<" and (m := AUTOLINK.match(s, at)):
            out.append(m[1])
            at = m.end()
        elif c == "<" and (m := TAG.match(s, at)):
            at = m.end()
        elif c == "&" and (m := ENTITY.match(s, at)):
            out.append(html.unescape(m[0]))
            at = m.end()
        else:
            out.append(c)
            at += 1
    emphasised(runs)
    return "".join(x.mark * x.left if isinstance(x, Marks) else x for x in out)


def emphasised(runs: list[Marks]) -> None:
    """Takes from the runs the marks that open and close emphasis. `bottom` is where openers of a kind were last sought in vain."""
    openers: list[Marks] = []
    bottom: dict[tuple, int] = {}
    for run in runs:
        kind = (run.mark, run.opens, run.n % 3)
        while run.closes and run.left:
            at = next((i for i in range(len(openers) - 1, bottom.get(kind, 0) - 1, -1) if openers[i].pairs(run)), None)
            if at is None:
                bottom[kind] = len(openers)
                break
            taken = 2 if min(openers[at].left, run.left) > 1 else 1
            openers[at].left -= taken
            run.left -= taken
            del openers[at + 1 if openers[at].left else at :]
            bottom = {k: min(v, len(openers)) for k, v in bottom.items()}
        if run.opens and run.left:
            openers.append(run)


def sections(markdown: str, title: str | None) -> list[tuple[str | None, str, int]]:
    """(heading path, text, where it begins) of each section. Paragraphs end in a blank line, but in items of tight lists; items end
    in a line; code stands as it is; raw HTML isn't seen. A heading in a quote or an item is one too."""
    blocks, out, buffer, stack, under, start = Blocks(markdown), [], [], [], title, 0
    for event in blocks.events:
        if event[0] == "heading":
            if "".join(buffer).strip():
                out.append((under, "".join(buffer), start))
                buffer = []
            start = event[3]
            while stack and stack[-1][0] >= event[1]:
                stack.pop()
            text = inline(event[2], blocks.labels)
            buffer.append("\n" * text.count("\n"))  # breaks between its lines belong to what follows
            if text := text.replace("\n", "").strip():
                stack.append((event[1], text))
            under = " > ".join(t for _, t in stack)
        elif event[0] == "paragraph":
            buffer.append(inline(event[1], blocks.labels) + ("\n\n" if event[2] is None or event[2].loose else ""))
        else:
            buffer.append(event[1] if event[0] == "code" else "\n")
    if "".join(buffer).strip():
        out.append((under, "".join(buffer), start))
    return out or [(title, markdown, 0)]


def packed(text: str, target: int, most: int, separator: str = "\n\n") -> list[str]:
    """Parts of a section: whole if small, else paragraphs gathered to the target; a paragraph over `most` goes by sentence. The
    estimates of what is held and of what comes are added, so what stands between them isn't counted."""
    if estimate(text) <= most:
        return [text]
    out, held = [], ""
    for p in text.split(separator):
        if not p.strip():
            continue
        pieces, limit, glue = ([p], target, separator) if estimate(p) <= most else ([s.strip() for s in re.split(r"(?<=[.!?])", p) if s.strip()], most, " ")
        for x in pieces:
            if held and estimate(held) + estimate(x) > limit:
                out.append(held)
                held = x
            else:
                held = held + glue + x if held else x
    return [*out, held] if held else out or [text]


def tail(s: str, tokens: int) -> str:
    """The last 4 bytes a token, from the start of a character."""
    b = s.encode()
    at = max(0, len(b) - 4 * tokens)
    while at > 0 and b[at] & 0xC0 == 0x80:
        at -= 1
    return b[at:].decode()


def tail_column(text, tokens: int):
    """tail() inside the JVM."""
    b = text.cast("binary")
    at = F.octet_length(text) - 4 * tokens + 1

    def inside(p):
        byte = F.substring(b, p, 1)
        return (byte >= F.lit(b"\x80")) & (byte < F.lit(b"\xc0"))

    start = F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)
    return F.when(at <= 1, text).otherwise(F.substring(b, start, 4 * tokens + 3).cast("string"))


def overlaps(docs: DataFrame, id_col: str, text, tokens: int = 50) -> DataFrame:
    """id, ordinal, overlap of each line: the tail of the line before, empty for the first. Rows don't leave their task."""
    tails = F.transform(F.split(text, "\n"), lambda x: tail_column(x, tokens))
    return docs.select(id_col, F.posexplode(F.concat(F.array(F.lit("")), F.slice(tails, 1, F.size(tails) - 1))).alias("ordinal", "overlap"))


def chunk(markdown: str, title: str | None = None, target: int = 400, most: int = 800, overlap: int = 50) -> list[tuple[int, str, str, str | None, int, int | None]]:
    """(ordinal, content, content hash, heading path, tokens, page). The hash is the part's, without the overlap before it. The page
    is that on which the part's section begins, where the text has pages, which form feeds end."""
    if not markdown or not markdown.strip():
        return []
    target = max(target, 1)
    most = max(most, target)
    out, before = [], ""
    ends = [m.start() for m in re.finditer("\f", markdown)]
    for path, text, start in sections(markdown, title):
        page = bisect.bisect_right(ends, start) + 1 if ends else None
        for part in packed(text, target, most):
            lead = tail(before, overlap) if before and overlap else ""
            content = (lead + ("" if not lead or lead.endswith("\n") else "\n") + part) if lead else part
            out.append((len(out), content, hashlib.sha256(part.encode()).hexdigest(), path, estimate(content), page))
            before = part
    return out


def chunked(docs: DataFrame, id_col: str, text: str, title: str | None = None, pages: bool = False, **limits) -> DataFrame:
    """id, ordinal, content, content_hash, heading_path, token_count of each chunk, with pages page_number too; a document that fails
    gives none."""
    names = [id_col, "ordinal", "content", "content_hash", "heading_path", "token_count", "page_number"]
    rows = docs.select(F.col(id_col), F.col(text).alias("_text"), (F.col(title) if title else F.lit(None).cast("string")).alias("_title"))

    def cut(batches):
        for b in batches:
            found = [(i, *c) for i, t, h in zip(b[id_col], b["_text"], b["_title"]) for c in chunk(t or "", h, **limits)]
            yield pd.DataFrame(found, columns=names).astype({"page_number": "Int32"})

    out = rows.mapInPandas(cut, f"{id_col} {dict(docs.dtypes)[id_col]}, ordinal int, content string, content_hash string, heading_path string, token_count int, page_number int")
    return out if pages else out.drop("page_number")


def greedy(docs: DataFrame, id_col: str, text, most: int = 800, summed: bool = False) -> DataFrame:
    """id, ordinal, content: sentences gathered up to `most` tokens, by a fold inside the JVM. The tokens are those of the joined
    text, or with summed, as in packed(), the sum of both parts' estimates."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(s, x):
        joined = F.when(s["held"] == "", x).otherwise(F.concat(s["held"], F.lit(" "), x))
        size = token_estimate(s["held"]) + token_estimate(x) if summed else token_estimate(joined)
        full = (s["held"] != "") & (size > most)
        return F.struct(F.when(full, F.array_append(s["done"], s["held"])).otherwise(s["done"]).alias("done"), F.when(full, x).otherwise(joined).alias("held"))

    parts = F.aggregate(sentences(text), empty, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.array_append(s["done"], s["held"])))
    return docs.select(id_col, F.posexplode(parts).alias("ordinal", "content"))
