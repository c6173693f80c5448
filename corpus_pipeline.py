"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of docs. Null texts are empty ones:
they are scored by the classifier's bias, link with nothing, are never contaminated, are repeated by complete epochs alone
and encode to their end id. An empty table passes through every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import decontaminate, jaccard, mixing, repair, toxicity
from quillmere.llm.common import materialize
from quillmere.llm.queries import table, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets that are alike by 0.8 or more: the smallest doc_id."""
    return jaccard.deduplicated(docs, 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed_documents(docs, quality=mixing.quality_weights(table(spark, sf_dir, "labels")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, from the files of its ids."""
    return repair.written(docs, tokenizer_path())


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("mixing", mixed), ("token_ids", token_ids)]

#: The classifier and the hashes have no SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
