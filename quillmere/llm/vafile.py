"""Exact top-k search by vector-approximation files: quantised cells bound every score, exact vectors settle the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import materialize, parts_for

#: Vectors of one row of the file, and queries that are broadcast at once.
BLOCK, QUERY_BLOCK = 2048, 4096
#: Cells per component.
CELLS = 256
LONG = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """place, vec_id, embedding: every row whose vector is not null and holds no null or non-finite component, repeated ones too.
    Places tell rows apart once they are written."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(fine)
    return kept.select(F.monotonically_increasing_id().alias("place"), "vec_id", "embedding")


def matrix(lists: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component, in doubles (whole numbers); shorter vectors are padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), max(1, int(n.max(initial=0)))))
    out[np.arange(out.shape[1]) < n[:, None]] = np.asarray(lists.flatten(), dtype=np.float64)
    return np.floor(256.0 * out)


def fitted(m: np.ndarray, dim: int) -> np.ndarray:
    return m[:, :dim] if m.shape[1] >= dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def approximated(vectors: DataFrame) -> DataFrame:
    """The file: rows of up to BLOCK vectors (places, ids, dim, low, step, cells), without the exact vectors. cells: one byte per component, cell c
    of it holds values from low + c * step to low + (c + 1) * step - 1."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = matrix(part.column("embedding"))
                low = m.min(0)
                step = np.maximum(1.0, np.ceil((m.max(0) - low + 1) / CELLS))
                cells = np.minimum((m - low) // step, CELLS - 1).astype(np.uint8)
                places, ids = (np.asarray(part.column(c), dtype=np.int64).tobytes() for c in ("place", "vec_id"))
                yield pa.RecordBatch.from_pydict({"places": [places], "ids": [ids], "dim": [m.shape[1]], "low": [low.tobytes()], "step": [step.tobytes()], "cells": [cells.tobytes()]})

    return vectors.select("place", "vec_id", "embedding").mapInArrow(pack, "places binary, ids binary, dim long, low binary, step binary, cells binary")


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of m with q; beyond the range of long they end there."""
    if m.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(m).max(initial=0)) < 2**52:
        return (m @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([max(-LONG, min(LONG, sum(a * int(b) for a, b in zip(whole, row)))) for row in m], dtype=np.int64)


def bounds(row: dict, qs: np.ndarray):
    """Of a row of the file: places of up to 256 queries at a time, and upper and lower bounds of their scores by its vectors."""
    dim = max(row["dim"], qs.shape[1])
    low, step = (fitted(np.frombuffer(row[c], np.float64).reshape(-1, row["dim"]), dim) for c in ("low", "step"))
    cells = fitted(np.frombuffer(row["cells"], np.uint8).reshape(-1, row["dim"]), dim)
    lo = low + cells * step
    hi = lo + np.maximum(step - 1, 0)
    for at in range(0, len(qs), 256):
        q = fitted(qs[at : at + 256], dim)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)  # rounding of very large values
        # no score lies beyond the range of long
        yield np.arange(at, at + len(q)), np.clip(plus @ hi.T + minus @ lo.T + slack, -LONG, LONG), np.clip(plus @ lo.T + minus @ hi.T - slack, -LONG, LONG)


def floors(file: DataFrame, sent, k: int) -> np.ndarray:
    """For each query the kth largest lower bound over the whole file, its own row aside; no bound where there are fewer."""

    def scan(batches):
        qids, qs = sent.value
        best = np.full((len(qids), k), -np.inf)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                for at, _, lower in bounds(row, qs):
                    lower[qids[at][:, None] == ids] = -np.inf
                    best[at] = np.partition(np.hstack([best[at], lower]), -k, axis=1)[:, -k:]
        at, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_pydict({"query": pa.array(at, pa.int64()), "lower": pa.array(best[np.isfinite(best)], pa.float64())})

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    kth = file.mapInArrow(scan, "query long, lower double").withColumn("rank", rank).where(F.col("rank") == k).select("query", "lower").toArrow()  # a row per query
    out = np.full(len(sent.value[0]), -np.inf)
    out[np.asarray(kth["query"], dtype=np.int64)] = np.asarray(kth["lower"])
    return out


def reached(file: DataFrame, sent, least) -> DataFrame:
    """place, asked, upper: the rows whose upper bound reaches the floor of a query, that query's place among the queries, the bound."""

    def scan(batches):
        qids, qs = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                places, ids = (np.frombuffer(row[c], np.int64) for c in ("places", "ids"))
                for at, upper, _ in bounds(row, qs):
                    of, which = np.nonzero((upper >= least.value[at][:, None]) & (qids[at][:, None] != ids))
                    if len(of):
                        yield pa.RecordBatch.from_arrays([pa.array(places[which]), pa.array(at[of], pa.int32()), pa.array(upper[of, which])], names=["place", "asked", "upper"])

    return file.mapInArrow(scan, "place long, asked int, upper double")


def settled(pairs: DataFrame, vectors: DataFrame, sent) -> DataFrame:
    """asked, query_id, vec_id, score: exact scores of pairs (place, asked), for which only the vectors named are read."""

    def score(batches):
        qids, qs = sent.value
        for batch in batches:
            m, asked = matrix(batch.column("embedding")), np.asarray(batch.column("asked"))
            dim = max(m.shape[1], qs.shape[1])
            m, q = fitted(m, dim), fitted(qs, dim)
            got = np.zeros(len(asked), np.int64)
            for i in np.unique(asked):
                some = np.flatnonzero(asked == i)
                got[some] = products(q[i], m[some])
            yield pa.RecordBatch.from_arrays([batch.column("asked"), pa.array(qids[asked]), batch.column("vec_id"), pa.array(got)], names=["asked", "query_id", "vec_id", "score"])

    rows = pairs.select("place", "asked").join(vectors, "place").select("asked", F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(score, "asked int, query_id long, vec_id long, score long")


def ahead(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group, with their rank; each task hands on its own first k."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def certain(pairs: DataFrame, vectors: DataFrame, sent, k: int) -> DataFrame:
    """query_id, vec_id, score of pairs (place, asked, upper) that may be among a query's k best. Vectors are read in the order of
    their bounds: of each query the k with the highest upper bounds first. The kth of these scores is one that the kth result has at
    least, so reading ends with the pairs whose upper bound reaches it; all others can't be among the results."""
    first = settled(ahead(pairs, "asked", [F.desc("upper"), F.asc("place")], k), vectors, sent)
    kth = ahead(first, "asked", [F.desc("score")], k).where(F.col("rank") == k).select("asked", F.col("score").cast("double").alias("kth"))
    left = pairs.join(kth, "asked", "left").where(F.col("upper") >= F.coalesce("kth", F.lit(float("-inf"))))
    return settled(left, vectors, sent).drop("asked")


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries (vec_id, embedding) the k rows of vectors with the highest
    integer inner product, ties to smaller vec_id; fewer where there are fewer. Rows with the query's vec_id count as its own and
    take no part. Every other row counts, repeated ones too: of rows with one vec_id each can be a result. Queries that
    share a vec_id share its k results. Vectors null or holding null or non-finite components take no part, neither as queries;
    shorter ones go on with zeros. An empty table gives no rows. Other columns are not looked at.

    The file is written once. Queries, a stated set, meet all of it in blocks of about QUERY_BLOCK, which with a floor each
    is all that is ever broadcast: the cells of all rows give each query's kth lower bound, then the pairs whose upper
    bound reaches it, and of these the exact vectors are read until the kth is certain."""
    spark = vectors.sparkSession
    clean = materialize(usable(vectors.select("vec_id", "embedding")), "vectors")
    file = materialize(approximated(clean), "va_file")
    asked = materialize(usable(queries.select("vec_id", "embedding")), "queries")
    n = asked.count()
    found = None
    for b in range(parts_for(n, QUERY_BLOCK, 1)):
        rows = asked.where(F.pmod(F.xxhash64("place"), F.lit(parts_for(n, QUERY_BLOCK, 1))) == b).toArrow()  # about QUERY_BLOCK rows
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast((np.asarray(rows["vec_id"], dtype=np.int64), matrix(rows["embedding"])))
        least = spark.sparkContext.broadcast(floors(file, sent, k))
        part = certain(materialize(reached(file, sent, least), "reached"), clean, sent, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    return ahead(found, "query_id", [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")
