"""Vector search and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.globs import glob_match
from quillmere.operators.text_index import bm25, top


def l2(vector, query: list[float]):
    """Exact distance in doubles, without leaving the JVM."""
    pairs = F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, id_col: str, vector: str, query: list[float], n: int) -> DataFrame:
    """The n nearest rows: partial top n in each task, merged."""
    return vectors.select(id_col, l2(vector, query).alias("distance")).orderBy("distance", id_col).limit(n)


def ranked(hits: DataFrame, id_col: str, by: str, rank: str) -> DataFrame:
    """1-based places of the few hits that are left after the limit and the path filter."""
    return hits.withColumn(rank, F.row_number().over(Window.orderBy(by, id_col))).select(id_col, rank)


def fused(id_col: str, vector_hits: DataFrame | None, keyword_hits: DataFrame | None, constant: int = 60) -> DataFrame:
    """id, vector_rank, keyword_rank, score: each list gives 1 / (constant + rank)."""
    v = vector_hits if vector_hits is not None else keyword_hits.select(id_col).limit(0).withColumn("vector_rank", F.lit(None).cast("int"))
    k = keyword_hits if keyword_hits is not None else vector_hits.select(id_col).limit(0).withColumn("keyword_rank", F.lit(None).cast("int"))
    both = v.join(k, id_col, "full_outer")
    score = F.coalesce(1.0 / (constant + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1.0 / (constant + F.col("keyword_rank")), F.lit(0.0))
    return both.withColumn("score", score)


def search(chunks: DataFrame, vectors: DataFrame, query: str, embedding: list[float] | None, k: int = 10, mode: str = "hybrid", path_glob: str | None = None, threshold: float | None = None, constant: int = 60, id_col: str = "chunk_id", path: str = "path", text="content", vector: str = "embedding", unicode: bool = True, keyword_hits: DataFrame | None = None) -> DataFrame:
    """One lazy plan: top n of each arm (2k for hybrid), the path filter above the limits, ranks, fusion, threshold, top k.
    keyword_hits takes the keyword arm's id and score from elsewhere (stored postings), in place of a pass over the texts."""
    n = 2 * k if mode == "hybrid" else k
    paths = chunks.select(id_col, path)

    def kept(hits):
        return hits if path_glob is None else hits.join(paths, id_col).where(glob_match(F.col(path), path_glob)).drop(path)

    v = kw = None
    if mode != "keyword" and embedding:
        v = ranked(kept(knn(vectors, id_col, vector, embedding, n)), id_col, "distance", "vector_rank")
    if mode != "vector":
        found = keyword_hits if keyword_hits is not None else bm25(chunks, id_col, text, query, unicode=unicode)
        kw = ranked(kept(top(found, id_col, n)), id_col, "score", "keyword_rank")
    if v is None and kw is None:
        return chunks.select(id_col, F.lit(None).cast("int").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank"), F.lit(0.0).alias("score")).limit(0)
    out = fused(id_col, v, kw, constant)
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), id_col).limit(k)
