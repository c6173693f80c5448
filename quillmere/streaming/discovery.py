"""Discovery as a stream: new files of a folder are merged into a registry, run to completion. An extension of our own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, checkpoint: str, merge: Callable[[DataFrame, int], None], pattern: str = "*") -> None:
    """Hands each batch of files (path, size, modified_ms) not yet seen to merge(batch, id); the checkpoint remembers them."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))
    query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge).start()
    query.awaitTermination()


def counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per window and kind, with late data up to the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
