"""Spelling variants against brute force over all deletions, hashes against zlib, and odd rows."""

import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import docs, odd  # noqa: F401

from quillmere.llm import variants


def brute_near(words):
    by, near = collections.defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "*" + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in near:
                near[w].add(x)
                near[x].add(w)
    for g in by.values():
        for a in g:
            near[a] |= g - {a}
    return near


def brute_counts(rows, letters, least, every):
    c = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += len(w) >= letters
    return {w: n for w, n in c.items() if n >= max(1, least)}


def brute(c, times=5):
    near, form = brute_near(c), {}
    for w in c:
        best = min(near[w], key=lambda x: (-c[x], x), default=None)
        if best and c[best] >= times * c[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c[w], len(near[w]), c.get(form.get(w))) for w in c)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("part_words", [1 << 17, 60])
def test_equals_brute_force(spark, docs, monkeypatch, part_words):
    """In one part, and in many whose nodes are shared."""
    monkeypatch.setattr(variants, "PART_WORDS", part_words)
    got = variants.variants(docs)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(brute_counts([tuple(r) for r in docs.select("doc_id", "text").collect()], 6, 5, 199))


def test_odd(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for letters, least, every in ((1, 1, 199), (1, 1, None), (2, 1, 3), (6, 5, 199)):
        assert {r["word"]: r["n"] for r in variants.word_counts(odd, letters, least, every).collect()} == brute_counts(rows, letters, least, every)
    assert variants.variants(odd).columns == COLUMNS


def test_letters_and_long_words(spark):
    """× and ÷ are in the range; capitals beyond Z stay; a word longer than the tables, a hit in it, one that vanishes."""
    rows = [(i, t) for i in range(40) for t in ("ÀÉ×÷ßÿ Ābcdef naïve_x", "b" * 300 + "c", "é" * 70, "a", None, "Q1q")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (2, 7):
        assert {r["word"]: r["n"] for r in variants.word_counts(d, 1, 1, every).collect()} == brute_counts(rows, 1, 1, every)


def test_joined_crc():
    tables = variants.shift_tables()
    heads, tails = [b"12:", b":", b"-9:"], ["word", "é", "x" * 64]
    got = variants.joined_crc(tables, np.array([zlib.crc32(x) for x in heads], np.uint32), np.array([zlib.crc32(x.encode()) for x in tails], np.uint32), np.array([len(x.encode()) for x in tails]))
    assert got.tolist() == [zlib.crc32(h + t.encode()) for h, t in zip(heads, tails)]


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=6), st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 30))
def test_any_words(spark, counts, part_words):
    """Each pair once, whatever the words and however the trie is cut."""
    was, variants.PART_WORDS = variants.PART_WORDS, part_words
    try:
        words = spark.createDataFrame(sorted(counts.items()), "word string, n long")
        pairs = [tuple(r) for r in variants.near_pairs(words).collect()]
        assert sorted(tuple(sorted((a, b))) for a, _, b, _ in pairs) == sorted({tuple(sorted((a, b))) for a, near in brute_near(counts).items() for b in near})
        assert all(counts[a] == n and counts[b] == m for a, n, b, m in pairs)
        got = variants.grouped(words).select(*COLUMNS)
        assert sorted(map(tuple, got.collect())) == brute(counts)
    finally:
        variants.PART_WORDS = was
