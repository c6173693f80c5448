"""Stored postings: the same scores as a pass over the texts, kept in step with chunks, built for stores that lack them."""

import json
import os

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F
from test_engine import put

from quillmere.engine import IndexVault, as_json
from quillmere.operators import text_index
from quillmere.operators.embed import HashEmbedder, embedding, mean_pooled


def scores(df):
    return {r[0]: round(r[1], 9) for r in df.collect()}


def test_postings_score_as_the_texts_do(spark, tmp_path):
    odd = [(1_000_001, "Café café crème"), (1_000_002, "кот и пёс"), (1_000_003, ""), (1_000_004, None), (1_000_005, "the and the and and the")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    path = str(tmp_path / "p")
    text_index.in_ranges(text_index.postings(docs, "doc_id", F.col("text")), "doc_id").write.parquet(path)
    stored = spark.read.parquet(path)
    lengths = docs.select(F.size(text_index.tokens(F.col("text"), True)).alias("n")).agg(F.count("*").alias("_n"), F.avg("n").alias("_avg"))
    for query in ("the", "the and", "and_the", "the_and_the", "cafe CAFÉ", "КОТ", "the zzzz", "", "_", "?!"):
        for all_terms in (True, False) if query in ("the and", "the zzzz", "cafe CAFÉ") else (True,):
            want = scores(text_index.bm25(docs, "doc_id", F.col("text"), query, all_terms))
            assert scores(text_index.bm25_of_postings(stored, lengths, "doc_id", query, all_terms)) == want, query
    plan = text_index.bm25_of_postings(stored, lengths, "doc_id", "the and")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [and,the])]" in plan


def test_top_of_postings_by_tiers(spark, tmp_path):
    """The k best are those of all rows, ties too; tiers that can't reach the kth score aren't read, and are skipped in the file."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    made = [(2_000_000 + i, "reef " * (1 + i % 3) + "sand " * (i % 2) + "filler " * (i * 7 % 300)) for i in range(400)]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    path = str(tmp_path / "p")
    text_index.in_ranges(text_index.postings(docs, "doc_id", F.col("text")), "doc_id").write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.where("dl / size(at) < pow(2, tier) OR tier < 20 AND dl / size(at) >= pow(2, tier + 1)").count() == 0
    lengths = docs.select(F.size(text_index.tokens(F.col("text"), True)).alias("n")).agg(F.count("*").alias("_n"), F.avg("n").alias("_avg")).cache()
    best = lambda df, k: [(r[0], round(r[1], 9)) for r in text_index.top(df, "doc_id", k).collect()]
    for query in ("reef", "sand reef", "the", "the and", "reef zzzz", "reef reef", "sand_reef", "", "_"):
        want = text_index.bm25_of_postings(stored, lengths, "doc_id", query)
        for k in (1, 5, 40, 1000) if query == "sand reef" else (5,):
            assert best(text_index.bm25_top(stored, lengths, "doc_id", query, k), k) == best(want, k), (query, k)
    whole, read = text_index.bm25_of_postings(stored, lengths, "doc_id", "reef").count(), text_index.bm25_top(stored, lengths, "doc_id", "reef", 5)
    assert 5 <= read.count() < whole / 3
    assert "PushedFilters: [IsNotNull(term), IsNotNull(tier), EqualTo(term,reef), LessThanOrEqual(tier," in read._jdf.queryExecution().toString()


def test_bounds_hold():
    for avg in (3.0, 120.0):
        for dl in (1, 2, 7, 100, 5000):
            for f in range(1, min(dl, 40) + 1):
                tier = min(text_index.LAST_TIER, int(np.floor(np.log2(dl / f))))
                got = f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg))
                assert all(got <= text_index.most_of_tier(t, avg) for t in range(tier + 1))


def test_postings_follow_chunks(spark, tmp_path):
    root = str(tmp_path)
    put(root, "reef.md", "# Reef\n\nCoral grows slowly.")
    put(root, "dune.md", "# Dune\n\nSand moves quickly.")
    put(root, "bare.md", "")
    v = IndexVault(spark, root, create=True, embedder=HashEmbedder(16))
    v.add()
    v.index()
    assert [tuple(r) for r in v.results().collect()] == [("bare.md", "failed", "no_chunks_produced", 0), ("dune.md", "indexed", None, 1), ("reef.md", "indexed", None, 1)]
    assert json.loads(as_json(v.results()))[1]["path"] == "dune.md" and json.loads(as_json(v.check())) == v.check()
    full = put(root, "reef.md", "# Reef\n\nSponges filter water.")
    os.utime(full, (2e9, 2e9))
    v.index()
    assert v.search("coral", mode="keyword").count() == 0 and v.search("sponges", mode="keyword").count() == 1
    assert set(v.check().values()) == {0}
    v.configure("retrieval.default_k", 1)
    assert v.search("sand", mode="vector").count() == 1
    with pytest.raises(ValueError, match="chunks"):
        v.configure("embedding.model", "other")
    with pytest.raises(ValueError, match="numbers"):
        IndexVault(spark, root, embedder=HashEmbedder(8)).index()
    state = os.path.join(root, ".quillmere/current.json")  # a store from before postings
    with open(state) as f:
        old = json.load(f)
    want = scores(v.search("sand", mode="keyword").select("chunk_id", "score"))
    del old["tables"]["postings"], old["schema"]
    with open(state, "w") as f:
        json.dump(old, f)
    again = IndexVault(spark, root, embedder=HashEmbedder(16))
    assert scores(again.search("sand", mode="keyword").select("chunk_id", "score")) == want and len(want) == 1
    assert again.store.migrate(again.MIGRATIONS) == []
    assert again.remove_all() == 3 and again.store.table("postings").count() == 0 and again.ls().count() == 0
    again.configure("embedding.model", "other")


@pytest.mark.parametrize(("key", "value"), [("chunking.target_tokens", 0), ("files.size_cap_bytes", -1), ("embedding.dimension", 8), ("crawl.default_strategy", "sideways"), ("output.annotate", 1)])
def test_settings_that_are_refused(spark, tmp_path, key, value):
    s = IndexVault(spark, str(tmp_path), create=True).store
    with pytest.raises(ValueError):
        s.set(key, value)
    s.set("crawl.default_strategy", "FULL")
    assert s.get("crawl.default_strategy") == "recursive"


def test_mean_pooling():
    hidden = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]] * 3], np.float32)
    got = mean_pooled(hidden, np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(got, [[0.6, 0.8], [0.0, 0.0]])


def test_vectors_of_another_length_are_refused(spark):
    class Wrong:
        dimension = 3

        def embed(self, texts):
            return [[1.0, 2.0] for _ in texts]

    with pytest.raises(Exception, match="another length"):
        spark.createDataFrame([("x",)], "t string").select(embedding(Wrong())("t")).collect()
