"""The chunker against one written here byte by byte, and against examples of the markdown rules worked out by hand."""

import hashlib
import random
import re

import pytest
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.operators.blocks import Blocks
from quillmere.operators.chunking import chunk, inline, sections
from quillmere.plans.queries import QUERIES


def size(b):
    return -(-len(b) // 4)


def cut_sentences(b):
    out, piece = [], bytearray()
    for x in b:
        piece.append(x)
        if x in b".!?":
            out.append(bytes(piece).strip())
            piece = bytearray()
    out.append(bytes(piece).strip())
    return [x for x in out if x]


def brute(text, title, target=400, most=800, overlap=50):
    """Chunks of a text of plain paragraphs, which is one section: (ordinal, content, hash, title, tokens)."""
    paragraphs, lines = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            lines.append(line.strip())
        elif lines:
            paragraphs.append("\n".join(lines).encode())
            lines = []
    if not paragraphs:
        return []
    whole = b"".join(p + b"\n\n" for p in paragraphs)
    parts, held = [], b""
    if size(whole) <= most:
        parts = [whole]
    else:
        for p in paragraphs:
            large = size(p) > most
            for x in cut_sentences(p) if large else [p]:
                if held and size(held) + size(x) > (most if large else target):
                    parts.append(held)
                    held = b""
                held += ((b" " if large else b"\n\n") if held else b"") + x
        parts += [held] if held else []
    out, lead = [], b""
    for i, p in enumerate(parts):
        content = lead + (b"\n" if lead and not lead.endswith(b"\n") else b"") + p
        out.append((i, content.decode(), hashlib.sha256(p).hexdigest(), title, size(content)))
        start = max(0, len(p) - 4 * overlap)
        while start < len(p) and p[start] >> 6 == 2:
            start -= 1
        lead = p[start:] if overlap else b""
    return out


PLAIN = re.compile(r"[\\`<&*_!\[#>~=]|(?m:^\s*(?:[-+]|\d+[.)])\s)|(?m:^(?: {4}|\t))|(?m:^\s*-+\s*$)|\r")


def test_chunk_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    plain = {r["doc_id"]: r for r in docs if not PLAIN.search(r["text"] or "")}
    got = {}
    for r in QUERIES["chunk_documents"](spark, SF).collect():
        if r["doc_id"] in plain:
            got.setdefault(r["doc_id"], []).append((r["ordinal"], r["content"], r["content_hash"], r["heading_path"], r["token_count"]))
    want = {i: brute(r["text"] or "", r["source"]) for i, r in plain.items()}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x} and len(plain) > len(docs) / 2


@pytest.mark.parametrize("seed", range(40))
def test_packing_of_random_texts(seed):
    rng = random.Random(seed)
    words = ["ab", "кит", "sea", "日本語", "a.", "so!", "why?", "e.g.", "longerword" * rng.randint(1, 9)]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(rng.randint(0, 400)))
    limits = (rng.randint(1, 60), rng.randint(1, 90), rng.randint(0, 12))
    assert not PLAIN.search(text.replace("!", "")) and [c[:5] for c in chunk(text, "t", *limits)] == brute(text, "t", limits[0], max(limits[:2]), limits[2])


@pytest.mark.parametrize(("text", "seen"), [
    ("*foo bar*", "foo bar"), ("a * foo bar*", "a * foo bar*"), ("foo*bar*", "foobar"), ("foo_bar_baz", "foo_bar_baz"), ("_(bar)_", "(bar)"),
    ("**foo *bar* baz**", "foo bar baz"), ("***strong*** x", "strong x"), ("*foo**bar**baz*", "foobarbaz"), ("*foo**bar*", "foo**bar"), ("one*** two*** three", "one*** two*** three"),
    ("**unclosed", "**unclosed"), ("a `b * c` *d*", "a b * c d"), ("`` x`y ``", "x`y"), ("`open", "`open"), (r"\*not\* \q", r"*not* \q"), ("[text *em*](https://h/(a)b 'T')!", "text em!"),
    ("![alt](p.png)", "alt"), ("[no link] (x)", "[no link] (x)"), ("a <b class='x'>c</b> 1 < 2 > 0", "a c 1 < 2 > 0"), ("<https://h/x>", "https://h/x"), ("&amp; &copy; &&& &#65; &nope", "& © &&& A &nope"), ("*two\nlines*", "two\nlines"), ("", ""),
])
def test_visible_text(text, seen):
    assert inline(text) == seen


def test_many_marks_take_no_square():
    assert len(inline("*a _b " * 20_000)) == 120_000 and inline("**" * 50_000 + "x") == "**" * 50_000 + "x"


def test_heading_paths():
    text = "lead\n\n# One\n\na\n\n### Three\n\nb\n\n## Two\n\nc\n\nSet\n===\n\nd\n\n#\n\ne\n\n```\n# code\n```\n"
    assert [x[:2] for x in sections(text, "T")] == [("T", "lead\n\n"), ("One", "a\n\n"), ("One > Three", "b\n\n"), ("One > Two", "c\n\n"), ("Set", "d\n\n"), ("", "e\n\n# code\n")]


def seen(text):
    return "".join(x[1] for x in sections(text, "T"))


@pytest.mark.parametrize(("text", "want"), [
    ("The year\n1986. It was a good one.\n", "The year\n1986. It was a good one.\n\n"), ("a\n1. b", "a\n\nb\n"), ("a\n-\nb", "b\n\n"), ("1. one\n2. two", "one\ntwo\n"),
    ("- a\n  b\n- c", "a\nb\nc\n"), ("- a\n\n  b\n- c", "a\n\nb\n\n\nc\n\n\n"), ("- a\n\n- b", "a\n\n\nb\n\n\n"), ("* a\n+ b", "a\nb\n"), ("- a\n- b\n\np", "a\nb\np\n\n"),
    ("- a\n  - b\n  - c\n- d", "ab\nc\n\nd\n"), ("- a\n  - b\n\n    c\n- d", "ab\n\nc\n\n\n\nd\n"), ("-\n  foo\n-\n\n  bar", "foo\n\nbar\n\n"), ("- a\n -b\nlazy", "a\n-b\nlazy\n"),
    ("> q\nlazy\n\n> r", "q\nlazy\n\nr\n\n"), ("> - a\n>\n> - b", "a\n\n\nb\n\n\n"), ("> ```\n> c\nout", "c\nout\n\n"), ("> a\n---\nb", "a\n\nb\n\n"), ("> a\n===", "a\n===\n\n"),
    ("    code\n\n    more\n\ntext", "code\n\nmore\ntext\n\n"), ("para\n    still", "para\nstill\n\n"), ("\tcode\n- \ta", "code\na\n"), ("```py\nx = 1\n\n  y\n```\nz", "x = 1\n\n  y\nz\n\n"), ("- ```\n  code\n  ```\n- x", "code\n\nx\n"), ("~~~\n```\n", "```\n"),
    ("<div>\n# not a heading\n</div>\n\nx", "x\n\n"), ("<!-- c\n# x\n-->\nafter", "after\n\n"), ("<b>x</b>\ny", "x\ny\n\n"), ("<b>\nx\n\ny", "y\n\n"), ("t\n<b>\nx", "t\n\nx\n\n"), ("<pre>\n\n# a\n</pre>\nb", "b\n\n"),
    ("[a]: http://x 'T'\n\n[a] and [b][a] and [c]", "a and b and [c]\n\n"), ("[A  b]:\n<u v>\n\n![q][a\nB] [a b][]", "q a b\n\n"), ("[a]: x y z\n\n[a]", "[a]: x y z\n\n[a]\n\n"), ("[a]: x\n===\n[a]", "===\na\n\n"), ("x\n[a]: y", "x\n[a]: y\n\n"),
    ("***\n- - -\n_ _ _\nfoo\\\nbar  \nbaz", "foo\nbar\nbaz\n\n"), ("a\r\nb\r\n\r\nc", "a\nb\n\nc\n\n"), ("Foo\nbar\n===\nx", "\nx\n\n"),
])
def test_blocks(text, want):
    assert seen(text) == want


def test_headings_anywhere():
    text = "> # Quoted *h*\n> x\n\n- ## In an item\n  y\n\nLong\nheading\n---\n\nz\n\n####### seven"
    assert [x[:2] for x in sections(text, None)] == [("Quoted h", "x\n\n"), ("Quoted h > In an item", "y\n"), ("Quoted h > Longheading", "\nz\n\n####### seven\n\n")]


MARKDOWN = ["# ", "- ", "* ", "> ", "1. ", "10) ", "2. ", "    ", "  ", "\t", "```\n", "~~~\n", "\n", "\n\n", "===\n", "---\n", "* * *\n", "+\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(MARKDOWN), st.from_regex("[a-z]{1,6}( [a-z]{1,4})?\n?", fullmatch=True)), max_size=40))
def test_no_letter_is_lost(parts):
    """Whatever the blocks, all letters and numbers but those of markers are in a heading or a text, in their order."""
    text = "".join(parts)
    want = re.sub(r"[^a-z]", "", text)
    events = Blocks(text).events
    got = re.sub(r"[^a-z]", "", "".join(str(e[2]) if e[0] == "heading" else e[1] for e in events if e[0] != "end"))
    info = re.sub(r"[^a-z]", "", "".join(re.findall(r"(?:```|~~~)\s*([a-z ]*)", text)))
    assert got == want or info  # words after a fence are its name


def test_pages():
    text = "a\n\f\n# B\n\nb\n\n# C\n\n\fc\n\n# D\n\nd"
    assert [(c[3], c[5]) for c in chunk(text, "T", 1, 1, 0)] == [("T", 1), ("B", 2), ("C", 2), ("D", 3)] and chunk("a\n\nb")[0][5] is None
