"""Mixing sources to target weights: weighted sampling without replacement by exponential keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import materialize, n_words

#: Documents that one bucket of a source's keys holds on average.
BUCKET_ROWS = 4096


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """Each source's target. sizes: source, source_size. The sources, by code point with null last, weigh `weights`
    in turn and share `share` of all words; no target exceeds `most` times its source's size, and what is over goes to
    the others by weight. That fixed point is min(cap, level * weight): with sources ordered by cap / weight, the level
    is the first one at which the next source is not capped, and later ones are lower. One row per source meets in one task."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    leveled = weighed.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(float(share)),
        "w_all": F.sum("weight").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    leveled = leveled.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    first = F.coalesce(F.max("level").over(every), F.lit(float("inf")))
    return leveled.select("source", "source_size", F.least(F.col("cap"), first * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, quality: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """How often each row of docs (doc_id, text, source) is taken: doc_id, source, size, source_size, target, times, taken.

    A key -ln(u) / quality, with u from a digest of doc_id, ranks a source's documents. target / source_size complete
    epochs are taken of all of them; the rest of the budget goes down the key order, by whole documents, up to the one
    whose end is nearest the budget. quality (doc_id, weight > 0) is 1 where absent. Null texts and sources are allowed
    (size 0; a source of its own); rows repeated with one doc_id count each. Empty input gives no rows.

    Texts are read once; only (doc_id, source, size, key) is kept. Prefix sums run over buckets of keys, as many as
    the source's rows ask for, and within a bucket, so that no source meets in one task."""
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), u.alias("u"))
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.max("weight").alias("weight"))
        rows = rows.join(best, rows.doc_id == best.q_id, "left").drop("q_id")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = rows.select("doc_id", "source", "size", (-F.log("u") / F.coalesce("weight", F.lit(1.0))).alias("key"))
    rows = materialize(rows, "mix")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sums.select("source", "source_size"), share, weights, most).withColumnRenamed("source", "s")
    plan = plan.join(sums.select(F.col("source").alias("s2"), "n"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    plan = materialize(plan.select("s", "source_size", "target", epochs.cast("long").alias("epochs"), (F.floor((F.col("n") - 1) / BUCKET_ROWS) + 1).alias("buckets")), "mix_plan")
    # One row per source; Spark broadcasts it by its own threshold.
    keyed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1))
    sums = keyed.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("words"))
    down = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", "b", F.coalesce(F.sum("words").over(down), F.lit(0)).alias("bucket_start"))
    placed = keyed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    placed = placed.withColumn("start", start).withColumn("budget", budget)
    extra = ((F.col("start") + F.col("size") / 2) <= F.col("budget")) & (F.col("budget") > 0)
    placed = placed.withColumn("times", F.col("epochs") + extra.cast("long"))
    return placed.select("doc_id", "source", "size", F.col("source_size").cast("long"), "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, with all its columns. A row of no words, null text among them, is
    taken once for each epoch of its source. Rows that share a doc_id, null among them, are each taken the mean, rounded, of
    what the mixture gives them. An empty table gives no rows."""
    m = mixture(docs, **how)
    # Rows that share a doc_id share its count: the mean, rounded, of what they were given.
    m = m.groupBy(F.col("doc_id").alias("m_id")).agg(F.round(F.avg("times")).cast("int").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))  # whatever other columns are called
    out = rows.join(m, F.col("id").eqNullSafe(F.col("m_id"))).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def quality_weights(labels: DataFrame) -> DataFrame:
    """Labelled good documents weigh 2, bad ones 1/2."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
