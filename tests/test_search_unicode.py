"""Keyword search over texts and terms of any script, against brute force."""

import math
import re
import unicodedata

import pytest
from helpers import SF

from pyspark.sql import functions as F

from quillmere.operators import search, text_index
from quillmere.plans.queries import QUERIES, TERMS

TEXTS = ["Привет, мир! foo", "東京 タワー", "un café crème", "UN CAFE\u0301 CREME", "é", "naïve foo_bar", "ΟΔΟΣ οδός", "हिन्दी भाषा", "가나 다", "plain words", None]


def cut(text):
    """Letters of ASCII under diacritics become bare, as in unicode61."""
    out = []
    for c in text or "":
        d = unicodedata.normalize("NFD", c)
        out.append(d[0] if d[0] < "\x80" else c)
    kept = "".join(c for c in "".join(out).lower() if unicodedata.category(c) != "Mn").replace("ς", "σ")
    return re.findall("[^\\W_]+", kept)


@pytest.mark.parametrize(("query", "ids"), [
    ("мир", [0]), ("МИР", [0]), ("東京", [1]), ("café", [2, 3]), ("cafe", [2, 3]), ("É", [4]), ("e", [4]), ("naive", [5]), ("foo_bar", [5]), ("crème un", [2, 3]),
    ("οδος", [6]), ("हिन्दी", [7]), ("다", [8]), ("caf", []), ("cr", []), ("мир plain", []), ("_", []),
])
def test_terms_of_any_script(spark, query, ids):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, content string")
    assert sorted(r["doc_id"] for r in text_index.bm25(docs, "doc_id", F.col("content"), query).collect()) == ids
    rows = search.search(docs.withColumn("path", F.lit("p")), None, query, None, mode="keyword", id_col="doc_id", text=F.col("content")).collect()
    assert sorted(r["doc_id"] for r in rows) == ids


def test_unicode_query_equals_brute_force(spark):
    docs = [(r["doc_id"], cut(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, mean, terms = len(docs), sum(len(t) for _, t in docs) / len(docs), TERMS.split()
    idf = {}
    for x in terms:
        k = sum(x in t for _, t in docs)
        idf[x] = max(math.log((n - k + 0.5) / (k + 0.5)), 0) or 1e-6
    want = {i: -sum(idf[x] * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in terms) for i, t in docs if all(x in t for x in terms)}
    got = {r["doc_id"]: r["score"] for r in QUERIES["keyword_bm25_all_terms_unicode"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
