import zlib

import numpy as np
from helpers import SF
from odd_rows import docs, odd  # noqa: F401
from pyspark.sql import functions as F
from test_operators import brute_contamination, brute_jaccard

import corpus_pipeline
from quillmere.llm import mixing, queries, toxicity
from quillmere.llm.common import materialize


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 0.3 * docs.count()
    at = 0
    for r in sorted(rows.collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages_on_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert docs.where("doc_id = 6").count() == 0 and docs.where("doc_id = 5").count() >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stages_equal_brute_force(spark):
    """Each stage on what the one before kept: rows by the scores, components, contamination and counts of brute force."""
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "text").collect())
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    calm = materialize(stages["toxicity"](spark, d, SF), "t")
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(d, toxicity.train(d, labels)).collect()}
    assert ids(calm) == sorted(i for i in ids(d) if score[i] < 0.5) and calm.columns == d.columns
    alone = materialize(stages["near_duplicates"](spark, calm, SF), "t")
    assert ids(alone) == [i for i, _, c in brute_jaccard(rows(calm), 5, 80) if i == c]
    fair = materialize(stages["decontamination"](spark, alone, SF), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(fair) == sorted(r[0] for r in brute_contamination(rows(alone), items) if not r[-1])
    mix = materialize(stages["mixing"](spark, fair, SF), "t")
    times = {r["doc_id"]: r["times"] for r in mixing.mixture(fair, quality=mixing.quality_weights(labels)).collect()}
    assert ids(mix) == sorted(i for i, n in times.items() for _ in range(n))
    t, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i, x in rows(mix):
        a = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(a), zlib.crc32(a.tobytes())))
        at += len(a)
    assert sorted(tuple(r) for r in stages["token_ids"](spark, mix, SF).orderBy(F.col("start")).collect()) == sorted(want)
