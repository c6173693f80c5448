"""Packing against the tokenizer itself, an exact round trip, and odd rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_rows import docs, odd  # noqa: F401

from quillmere.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "Zb", "é", "1", "²", ".", ",", "'s", "'", "!", "#", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "\U0001f600", "́", "-", "​", "\r\n", "　", "中", "﻿", "᠎", "…"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_stretches_have_the_ids_of_the_whole(tokenizer):
    made = random.Random(7)
    texts = ["".join(made.choice(PARTS) for _ in range(made.randrange(10))) for _ in range(4000)] + [None, ""]
    enc = packing.Encoder(PATH)
    assert enc.by_stretch
    ids, ends = enc.encode(pa.array(texts), 0)
    for t, got in zip(texts, np.split(ids, ends[:-1])):
        assert got.tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], t


def test_whole_texts_by_other_files(tokenizer):
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_stretch
    ids, ends = other.encode(pa.array(["a b", None, "Ab, c"]), 2)
    assert ends[1] - ends[0] == 1 and ids[-1] == 2 and len(ids) == ends[-1]


def test_pieces():
    for longest in (1, 2, 8, 1024):
        lens = np.array([1, 2, 3, 7, 8, 9, 1023, 1024, 1025, 5000])
        of, start, length = packing.pieces(lens, longest)
        for i, n in enumerate(lens.tolist()):
            mine = sorted(zip(start[of == i].tolist(), length[of == i].tolist()))
            assert [s for s, _ in mine] == np.cumsum([0] + [k for _, k in mine])[:-1].tolist() and sum(k for _, k in mine) == n
            assert all(k & (k - 1) == 0 and k <= longest for _, k in mine)
            assert sum(k < longest for _, k in mine) == bin(n % longest).count("1")


def test_equals_tokenizer(spark, docs, odd, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    for d, longest in ((docs, 1024), (odd, 1024), (odd, 16)):
        want = collections.Counter()
        for r in d.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            at = 0
            for n in [longest] * (len(ids) // longest) + [1 << b for b in reversed(range(longest.bit_length())) if len(ids) % longest & 1 << b]:
                want[r["doc_id"], at, n, len(ids), 0, zlib.crc32(ids[at : at + n].tobytes())] += 1
                at += n
        rows = packing.packed(d.repartition(3), PATH, longest=longest).collect()
        assert collections.Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"], zlib.crc32(r["ids"])) for r in rows) == want
        assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_buckets_and_types(spark, tmp_path):
    """Sequences of one length are read alone; doc_ids keep their type; a length that is no power of two is refused."""
    d = spark.createDataFrame([("x", "some words here " * 9, "own"), ("y", None, "own"), (None, "a", "own")], "doc_id string, text string, length string")
    rows = packing.packed(d, PATH, longest=8, folder=f"file://{tmp_path}/s").collect()
    one = packing.sequences(spark, f"file://{tmp_path}/s", d.schema["doc_id"].dataType, length=8).collect()
    assert sorted(r["sequence_id"] for r in one) == sorted(r["sequence_id"] for r in rows if r["length"] == 8) and {r["doc_id"] for r in one} == {"x"}
    assert sorted(r["doc_id"] or "" for r in rows if r["length"] == 1) in (["y"], ["", "x", "y"], ["x", "y"], ["", "y"])
    with pytest.raises(ValueError):
        packing.packed(d, PATH, longest=100)
