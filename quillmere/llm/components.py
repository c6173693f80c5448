"""Connected components of links between keys of any type, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of links (a, b). Each round is two grouped joins over
    at most as many links as nodes hold; links are written between rounds and only a count and a sum reach the driver."""

    def directed(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = materialize(directed(links), "links")
    was = mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = directed(both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = materialize(large, "stars")
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        met = large.join(least, F.col("a") == F.col("k"))
        now = materialize(directed(met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))), "links")
        if (is_now := mark(now)) == was:
            break
        was = is_now
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
