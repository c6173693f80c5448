"""Reconciling operators: classification of files and conversions, crawl merges, prunes, status and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import scalars as S


def index_decision(supported: list[str], excluded: list[str], cap: int, force: bool = False, retry_failed: bool = False) -> Column:
    """The state a registered file takes, 'skipped', or 'work'. Columns: exists, is_file, ext, size, mtime, status, last_mtime, last_size."""
    e = F.coalesce(F.lower("ext"), F.lit(""))
    same = F.col("mtime").eqNullSafe(F.col("last_mtime")) & F.col("size").eqNullSafe(F.col("last_size"))
    return (
        F.when(~F.col("exists"), "missing")
        .when(~F.col("is_file"), "failed")
        .when(~e.isin(supported), "unsupported")
        .when(e.isin(excluded) if excluded else F.lit(False), "excluded")
        .when(F.col("size") > cap, "too_large")
        .when((F.col("status") == "indexed") & F.lit(not force) & same, "skipped")
        .when((F.col("status") == "failed") & F.lit(not retry_failed and not force), "skipped")
        .otherwise("work")
    )


def convert_decision(force: bool = False, retry_failed: bool = False, overwrite: bool = False, keep_existing: bool = False) -> Column:
    """What a conversion does. Columns: status, src_hash, last_src_hash, out_hash (null where there is no output), last_out_hash."""
    src = F.col("last_src_hash").isNull() | (F.col("last_src_hash") != F.col("src_hash"))
    out = F.coalesce((F.col("last_out_hash") != F.col("out_hash")), F.lit(False))
    clash = (F.col("status") == "conflict") | (src & out)
    skip = F.when((F.col("status") == "failed") & F.lit(not retry_failed and not force), "skipped")
    if not overwrite:
        skip = skip.when(clash, "kept_existing_output" if keep_existing else "conflict")
    return skip.when(~src & out, "output_modified").when((F.col("status") == "converted") & ~src & ~out & F.lit(not force), "skipped").otherwise("convert")


def crawl_merge(seen: DataFrame, registry: DataFrame, cap: int = 0, full: bool = True) -> DataFrame:
    """uri, status, outcome (discovered, updated, gone or null), content_hash: one full join of what a run saw (uri, size,
    modified_ms, content_hash) with the source's registry rows (the same and status)."""
    old = registry.select(F.col("uri").alias("o_uri"), *[F.col(c).alias(f"o_{c}") for c in ("size", "modified_ms", "content_hash", "status")])
    both = seen.join(old, F.col("uri") == F.col("o_uri"), "full_outer")
    new, known = F.col("uri").isNotNull(), F.col("o_uri").isNotNull()
    large = F.lit(cap > 0) & (F.col("size") > cap)
    changed = S.doc_changed("size", "o_size", "modified_ms", "o_modified_ms", "content_hash", "o_content_hash", "o_status")
    gone = ~new & F.lit(full) & (F.col("o_status") != "gone")
    status = F.when(gone, "gone").when(~new, F.col("o_status")).when(F.coalesce(large, F.lit(False)), "too_large").when(known & changed, "modified").otherwise("present")
    outcome = F.when(gone, "gone").when(new & ~known, "discovered").when(new & known & changed, "updated")
    return both.select(F.coalesce("uri", "o_uri").alias("uri"), status.alias("status"), outcome.alias("outcome"), F.when(new, F.coalesce("content_hash", "o_content_hash")).otherwise(F.col("o_content_hash")).alias("content_hash"))


def tally(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with the count of each value, in one pass."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("registered"))


def pruned(registry: DataFrame, status: str = "missing", all_but: str | None = None) -> DataFrame:
    gone = F.col("status") != all_but if all_but else F.col("status") == status
    return registry.where(~gone)


def prune_report(registry: DataFrame, status: str = "missing", all_but: str | None = None) -> DataFrame:
    gone = F.col("status") != all_but if all_but else F.col("status") == status
    return registry.where(gone).groupBy("status").agg(F.count("*").alias("removed")).orderBy("status")


def added(registry: DataFrame, paths: DataFrame) -> DataFrame:
    """path, outcome: added or already_registered, of distinct paths."""
    known = registry.select(F.col("path").alias("k")).distinct()
    return paths.select("path").distinct().join(known, F.col("path") == F.col("k"), "left").select("path", F.when(F.col("k").isNull(), "added").otherwise("already_registered").alias("outcome"))


def orphans(children: DataFrame, parents: DataFrame, on: str, alive: Column | None = None) -> DataFrame:
    """Children whose parent is absent, or does not satisfy `alive`."""
    return children.join(parents.where(alive) if alive is not None else parents, on, "left_anti")


def new_in_last_run(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents that the last run of their source was the first to see. sources: id, last_run_id."""
    last = sources.where(F.col("last_run_id").isNotNull()).select(F.col("id").alias("source_id"), F.col("last_run_id").alias("first_run_id"))
    return documents.join(last, ["source_id", "first_run_id"], "left_semi")
