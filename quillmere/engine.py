"""Vaults: the lifecycle API over the store, for indexing and search, for conversion, and for discovery."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere import schema
from quillmere.functions import globs
from quillmere.functions import scalars as S
from quillmere.operators import chunking, lifecycle, search, text_index
from quillmere.operators.embed import Embedder, HashEmbedder, embedding
from quillmere.session import written
from quillmere.sources import extract, graph, library, local
from quillmere.store import Store, writes

INDEXABLE = ["md", "markdown", "txt", "text", "pdf", "docx", "epub"]


def now_ms() -> int:
    return int(time.time() * 1000)


def as_json(value) -> str:
    """A report as indented JSON: a vault's counts, or the rows of a table of reports (small; whole tables are exported by tasks)."""
    return json.dumps([json.loads(x) for x in value.toJSON().collect()] if isinstance(value, DataFrame) else value, indent=2, ensure_ascii=False)


def searched_text():
    """What keyword search sees of a chunk: its content and headings."""
    return F.concat_ws("\n", "content", "heading_path")


def with_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("n_terms", F.size(text_index.tokens(searched_text(), True)))


def chunk_postings(chunks: DataFrame) -> DataFrame:
    return text_index.postings(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id", searched_text())


def postings_of_old_stores(store: Store) -> dict[str, DataFrame]:
    """Stores from before postings get them, and the lengths of their chunks."""
    chunks = store.table("chunks")
    return {"chunks": with_lengths(chunks), "postings": text_index.in_ranges(chunk_postings(chunks), "chunk_id")}


def ignore_lines(root: str, name: str) -> list[str]:
    try:
        with open(os.path.join(root, name)) as f:
            return f.read().splitlines()
    except FileNotFoundError:
        return []


def gathered(spark: SparkSession, root: str, paths: list[str] | None, ignore: list[str] | None, leave: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """path of the files at or below paths that can be extracted and that no rule ignores (none do where ignore is None), and
    how many files were found. Tasks walk; ignored folders and those in `leave` are never entered."""
    given = [os.path.relpath(os.path.realpath(os.path.join(root, p)), root).replace(os.sep, "/") for p in paths or ["."]]
    given = ["" if p == "." else p for p in given]
    files = [p for p in given if os.path.isfile(os.path.join(root, p))]
    lines = ignore or []
    rows = spark.createDataFrame([(p,) for p in files], "path string")
    rows = rows.withColumn("fit", F.lit(True) if ignore is None else ~globs.ignored(F.col("path"), lines))
    if folders := sorted({p for p in given if p not in files}):
        below = local.tree(spark, root, folders, ignore_lines=lines, built_in=ignore is not None, leave=(".quillmere", *leave))
        rows = rows.unionByName(below.where("kind IN ('file', 'ignored')").select("path", (F.col("kind") == "file").alias("fit")))
    rows = rows.distinct()
    ext = S.extension(F.element_at(F.split("path", "/"), -1))
    return rows.where(F.col("fit") & F.coalesce(ext.isin(INDEXABLE), F.lit(False))).select("path"), rows.count()


def tiers_of_old_stores(store: Store) -> dict[str, DataFrame]:
    """Postings from before tiers get them, and their order."""
    rows = store.table("postings").withColumn("tier", text_index.tier_of(F.col("at"), F.col("dl")))
    return {"postings": text_index.in_ranges(rows, "chunk_id")}


class IndexVault:
    """Files below a root: registered, chunked, embedded and searched. Chunks exist only for indexed files."""

    SCHEMAS = {"files": schema.FILES, "chunks": schema.CHUNKS, "vectors": schema.VECTORS, "postings": schema.POSTINGS, "results": schema.RESULTS}
    MIGRATIONS = {1: postings_of_old_stores, 2: tiers_of_old_stores}
    IGNORE = ".vaultignore"

    def __init__(self, spark: SparkSession, root: str, create: bool = False, embedder: Embedder | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root, self.SCHEMAS, create)
        self.root, self.embedder = self.store.root, embedder or HashEmbedder()
        self.store.migrate(self.MIGRATIONS)

    @writes
    def configure(self, key: str, value) -> None:
        """Sets a setting, or clears it with None; those that chunks depend on can't change while there are any."""
        if key in schema.WITHOUT_CHUNKS and not self.store.table("chunks").isEmpty():
            raise ValueError(f"{key} stands while there are chunks: remove all files first")
        self.store.set(key, value)

    @writes
    def add(self, paths: list[str] | None = None, no_ignore: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Registers files below paths as pending; files of other kinds and ignored ones are skipped."""
        fit, found = gathered(self.spark, self.root, paths, [] if no_ignore else ignore_lines(self.root, self.IGNORE))
        files = self.store.table("files")
        outcome = lifecycle.added(files, fit).persist()
        report = {r["outcome"]: r["count"] for r in outcome.groupBy("outcome").count().collect()} | {"skipped": found - fit.count()}
        if not dry_run:
            with self.store.lock():
                top = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
                new = outcome.where("outcome = 'added'").select((F.xxhash64("path").bitwiseAND(2**40 - 1) + top + 1).alias("id"), "path", F.lit(now_ms()).alias("added_at"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"))
                self.store.append({"files": files.limit(0).unionByName(new, allowMissingColumns=True)}, unique={"files": [["path"], ["id"]]})
        outcome.unpersist()
        return {"added": 0, "already_registered": 0} | report

    @writes
    def remove(self, paths: list[str]) -> dict[str, list[str]]:
        """Unregisters paths with their chunks and vectors; reports those that weren't registered."""
        files = self.store.table("files")
        wanted = self.spark.createDataFrame([(p,) for p in paths], "path string")
        known = {r[0] for r in wanted.join(files.select("path"), "path", "left_semi").collect()}
        self._drop(files.join(wanted, "path", "left_semi"))
        return {"removed": sorted(known), "not_found": sorted(set(paths) - known)}

    @writes
    def remove_all(self) -> int:
        """Unregisters every file, with chunks, vectors and postings; returns how many."""
        files = self.store.table("files")
        n = files.count()
        self.store.commit({t: self.store.table(t).limit(0) for t in ("files", "chunks", "vectors", "postings")})
        return n

    def _drop(self, files: DataFrame) -> None:
        """Unregisters files, with their chunks, vectors and postings, by delete lists: nothing that stays is written again."""
        paths = files.select("path")
        ids = self._chunk_ids(paths)
        self.store.append({}, {"files": paths, "chunks": paths, "vectors": ids, "postings": ids})

    def _chunk_ids(self, paths: DataFrame) -> DataFrame:
        return self.store.table("chunks").join(paths, "path", "left_semi").select("id")

    @writes
    def prune(self, status: str = "missing", all_non_indexed: bool = False, dry_run: bool = False) -> dict[str, int]:
        how = {"all_but": "indexed"} if all_non_indexed else {"status": status}
        files = self.store.table("files")
        report = {r["status"]: r["removed"] for r in lifecycle.prune_report(files, **how).collect()}
        if not dry_run and report:
            self._drop(files.join(lifecycle.pruned(files, **how), "path", "left_anti"))
        return report

    def ls(self, status: str | None = None) -> DataFrame:
        files = self.store.table("files")
        return (files.where(F.col("status") == status) if status else files).orderBy("path")

    def _joined(self, paths: list[str] | None) -> DataFrame:
        files = self.store.table("files")
        if paths is not None:
            files = files.join(self.spark.createDataFrame([(p,) for p in paths], "path string").distinct(), "path", "left_semi").select(*files.columns)
        return files.join(local.stats(self.spark, self.root, files), "path").withColumn("ext", S.extension(F.element_at(F.split("path", "/"), -1)))

    def decided(self, force: bool = False, retry_failed: bool = False, paths: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
        return self._joined(paths).withColumn("decision", lifecycle.index_decision(INDEXABLE, excluded or [], self.store.get("files.size_cap_bytes"), force, retry_failed))

    @writes
    def index(self, force: bool = False, retry_failed: bool = False, paths: list[str] | None = None, excluded: list[str] | None = None) -> dict[str, int]:
        """Classifies, extracts, chunks and embeds what has changed, and commits files, chunks, vectors and postings together, with
        each file's outcome (see results). What is written is in proportion to what has changed (see Store)."""
        at = now_ms()
        sample = self.store.table("vectors").select(F.size("embedding")).first()
        if sample and sample[0] != self.embedder.dimension:
            raise ValueError(f"the store's vectors have {sample[0]} numbers, the embedder's {self.embedder.dimension}")
        todo = self.decided(force, retry_failed, paths, excluded).persist()
        got = extract.extracted(todo.where("decision = 'work'")).persist()
        limits = {"target": self.store.get("chunking.target_tokens"), "most": self.store.get("chunking.max_tokens"), "overlap": self.store.get("chunking.overlap_tokens")}
        named = got.where("kind = 'ok'").withColumn("title", S.file_stem(F.element_at(F.split("path", "/"), -1)))
        cut = chunking.chunked(named, "path", "markdown", "title", pages=True, **limits)
        salt = str(at)
        new = with_lengths(cut).select(F.sha2(F.concat_ws("\u0001", "path", "ordinal", "content_hash", F.lit(salt)), 256).alias("id"), "path", "ordinal", "content", "content_hash", "heading_path", "page_number", "token_count", F.lit(at).alias("created_at"), "n_terms").persist()
        some = new.groupBy("path").agg(F.count("*").alias("n_chunks"))
        all_ = todo.join(got.select("path", "kind", "detail", "message", F.col("hash").alias("new_hash")), "path", "left").join(some, "path", "left")
        final = F.when(F.col("decision") == "skipped", F.lit("skipped")).when(F.col("decision") != "work", F.col("decision")).when(F.col("kind") != "ok", F.col("kind")).when(F.col("n_chunks").isNull(), "failed").otherwise("indexed")
        detail = F.when(F.col("decision") == "unsupported", "extension_not_supported").when(F.col("decision") == "excluded", "extension_excluded_by_config").when(F.col("decision") == "too_large", "size_exceeds_cap").when(F.col("decision") == "failed", "path_not_a_file").when((F.col("kind") == "ok") & F.col("n_chunks").isNull(), "no_chunks_produced").otherwise(F.col("detail"))
        done = all_.withColumn("outcome", final).withColumn("new_detail", detail).persist()
        ok, skip = F.col("outcome") == "indexed", F.col("outcome") == "skipped"

        work = done.where(~skip)
        changed = work.select(
            "id", "path", "added_at", F.col("outcome").alias("status"), F.when(~ok, F.col("new_detail")).alias("status_detail"), F.when(~ok, F.col("message")).alias("status_note"),
            *[F.when(ok, F.col(now)).otherwise(F.col(was)).alias(was) for now, was in (("mtime", "last_mtime"), ("size", "last_size"), ("new_hash", "last_hash"))],
            F.when(ok, F.lit(at)).otherwise(F.col("last_indexed")).alias("last_indexed"),
            F.when(F.col("outcome") == "failed", F.col("attempts") + 1).otherwise(0).alias("attempts"), F.lit(at).alias("last_attempt"))
        touched = work.select("path")
        replaced = self.store.table("chunks").join(done.where(ok).select("path"), "path", "left_semi").count()
        fresh = new.select(F.col("id").alias("chunk_id"), embedding(self.embedder)("content").alias("embedding"))
        gone = self._chunk_ids(touched)
        results = (work if paths is None else done).select("path", "outcome", F.when(~ok & ~skip, F.col("new_detail")).alias("detail"), F.when(ok, F.col("n_chunks")).otherwise(0).alias("chunks"))
        self.store.append(
            {"files": changed, "chunks": new, "vectors": fresh, "postings": text_index.in_ranges(chunk_postings(new), "chunk_id")},
            {"files": touched, "chunks": touched, "vectors": gone, "postings": gone},
            {"files": [["path"], ["id"]], "chunks": [["id"]], "vectors": [["chunk_id"]]}, {"results": results}, {"index": {"at": at, "all": paths is None}})
        report = {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}
        report |= {"chunks_added": new.count(), "chunks_replaced": replaced}
        for df in (todo, got, new, done):
            df.unpersist()
        return report

    def results(self) -> DataFrame:
        """path, outcome, detail, chunks of each file of the last index run, by path whatever order tasks ended in. A run over all
        files stores what it did; the others that were registered then are the skipped ones."""
        found, run = self.store.table("results"), self.store.note("index")
        if run and run["all"]:
            rest = self.store.table("files").where(F.col("added_at") <= run["at"]).join(found, "path", "left_anti")
            found = found.unionByName(rest.select("path", F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("chunks")))
        return found.orderBy("path")

    def search(self, query: str, k: int | None = None, mode: str = "hybrid", path_glob: str | None = None, threshold: float | None = None) -> DataFrame:
        """chunk_id, path, ordinal, heading_path, page_number, content, score, vector_rank, keyword_rank."""
        chunks = self.store.table("chunks").withColumnRenamed("id", "chunk_id")
        e = None if mode == "keyword" else self.embedder.embed([query])[0]
        lengths = chunks.agg(F.count("*").alias("_n"), F.avg("n_terms").alias("_avg"))
        k = k or self.store.get("retrieval.default_k")
        found = None if mode == "vector" else text_index.bm25_top(self.store.table("postings"), lengths, "chunk_id", query, 2 * k if mode == "hybrid" else k)
        hits = search.search(chunks, self.store.table("vectors"), query, e, k, mode, path_glob, threshold, self.store.get("retrieval.rrf_constant"), keyword_hits=found)
        return hits.join(chunks, "chunk_id").select("chunk_id", "path", "ordinal", "heading_path", "page_number", "content", "score", "vector_rank", "keyword_rank").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"))

    def show(self, path: str | None = None, chunk_id: str | None = None) -> DataFrame:
        chunks = self.store.table("chunks")
        return chunks.where(F.col("id") == chunk_id) if chunk_id else chunks.where(F.col("path") == path).orderBy("ordinal")

    def status(self) -> dict[str, int]:
        """Counts by state, and what an index run would do, in one pass over files joined with the disk."""
        d = self.decided()
        status, work = F.col("status"), F.col("decision") == "work"
        row = d.agg(
            *[F.count_if(status == s).alias(s) for s in schema.FILE_STATES], F.count_if((status == "indexed") & work).alias("modified"), F.count_if(work).alias("would_process"),
            F.count_if(status == "missing").alias("prune_would_remove"), F.count_if(~F.col("exists")).alias("lost"), F.count("*").alias("registered")).first()
        there, _ = gathered(self.spark, self.root, None, ignore_lines(self.root, self.IGNORE))
        untracked = there.join(self.store.table("files"), "path", "left_anti").count()
        return row.asDict() | {"untracked": untracked}

    def check(self) -> dict[str, int]:
        """Breaches of the invariant: chunks of files that aren't indexed, chunks and vectors without each other, postings without
        chunks."""
        files, chunks, vectors = (self.store.table(t) for t in ("files", "chunks", "vectors"))
        ids = chunks.select(F.col("id").alias("chunk_id"))
        return {
            "orphan_chunks": lifecycle.orphans(chunks, files, "path", F.col("status") == "indexed").count(),
            "chunks_without_vector": ids.join(vectors, "chunk_id", "left_anti").count(), "vectors_without_chunk": vectors.join(ids, "chunk_id", "left_anti").count(),
            "postings_without_chunk": self.store.table("postings").join(ids, "chunk_id", "left_anti").count(),
        }


class ConvertVault:
    """Files to annotated markdown, with lineage and conflicts: decisions are one plan, texts are read and written by tasks."""

    SCHEMAS = {"outputs": schema.OUTPUTS, "results": schema.CONVERSIONS}
    IGNORE = ".mdignore"

    def __init__(self, spark: SparkSession, root: str, create: bool = False) -> None:
        self.spark, self.store = spark, Store(spark, root, self.SCHEMAS, create)
        self.root = self.store.root

    @writes
    def add(self, paths: list[str] | None = None, no_ignore: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Registers files at or below paths as pending. The folder of outputs is never entered; files of other kinds and ignored
        ones are skipped."""
        outputs = self.store.table("outputs")
        fit, found = gathered(self.spark, self.root, paths, None if no_ignore else ignore_lines(self.root, self.IGNORE), (self.store.get("output.dir"),))
        new = lifecycle.added(outputs.select(F.col("input_path").alias("path")), fit).persist()
        report = {r["outcome"]: r["count"] for r in new.groupBy("outcome").count().collect()} | {"skipped": found - fit.count()}
        if not dry_run:
            rows = new.where("outcome = 'added'").select(F.xxhash64("path").bitwiseAND(2**62 - 1).alias("id"), F.col("path").alias("input_path"), F.lit(now_ms()).alias("added_at"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"))
            self.store.append({"outputs": outputs.limit(0).unionByName(rows, allowMissingColumns=True)}, unique={"outputs": [["input_path"], ["id"]]})
        new.unpersist()
        return {"added": 0, "already_registered": 0} | report

    @writes
    def remove(self, paths: list[str]) -> dict[str, list[str]]:
        """Unregisters inputs; their output files stay. Reports those that weren't registered."""
        outputs = self.store.table("outputs")
        wanted = self.spark.createDataFrame([(p,) for p in paths], "input_path string")
        known = {r[0] for r in wanted.join(outputs, "input_path", "left_semi").collect()}
        self.store.append({}, {"outputs": wanted})
        return {"removed": sorted(known), "not_found": sorted(set(paths) - known)}

    @writes
    def prune(self, status: str = "missing", all_non_converted: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Unregisters inputs of a state, or of every state but converted."""
        how = {"all_but": "converted"} if all_non_converted else {"status": status}
        outputs = self.store.table("outputs")
        report = {r["status"]: r["removed"] for r in lifecycle.prune_report(outputs, **how).collect()}
        if report and not dry_run:
            self.store.commit({"outputs": lifecycle.pruned(outputs, **how)})
        return report

    def ls(self, status: str | None = None) -> DataFrame:
        outputs = self.store.table("outputs")
        return (outputs.where(F.col("status") == status) if status else outputs).orderBy("input_path")

    def _state(self, outputs: DataFrame) -> DataFrame:
        """input_path, src_hash, src_size, out_hash of registered inputs, hashed by tasks; null where there is no file."""
        root = self.root

        def run(batches):
            import pandas as pd

            for b in batches:
                rows = []
                for path, out in zip(b["input_path"], b["output_path"]):
                    full = os.path.join(root, path)
                    here = os.stat(full) if os.path.isfile(full) else None
                    rows.append((path, extract.hashed(full), here and here.st_size, here and int(here.st_mtime * 1000), extract.hashed(os.path.join(root, out)) if isinstance(out, str) else None))
                yield pd.DataFrame(rows, columns=["input_path", "src_hash", "src_size", "src_mtime", "out_hash"]).astype({"src_size": "Int64", "src_mtime": "Int64"})

        return outputs.select("input_path", "output_path").mapInPandas(run, "input_path string, src_hash string, src_size long, src_mtime long, out_hash string")

    def status(self) -> dict[str, int]:
        """Counts by state, of converted inputs that have changed and of outputs that were edited, and both together (conflicts to come)."""
        outputs = self.store.table("outputs")
        d = outputs.join(self._state(outputs), "input_path")
        done = F.col("status") == "converted"
        src = F.coalesce(F.col("src_hash") != F.col("last_src_hash"), F.lit(False))
        out = F.coalesce(F.col("out_hash") != F.col("last_out_hash"), F.lit(False))
        counts = [F.count_if(F.col("status") == s).alias(s) for s in schema.OUTPUT_STATES]
        to_come = {"source_changed": done & src & ~out, "output_modified": done & out & ~src, "would_conflict": done & src & out, "lost": F.col("src_hash").isNull()}
        return d.agg(*counts, *[F.count_if(c).alias(n) for n, c in to_come.items()], F.count("*").alias("registered")).first().asDict()

    @writes
    def convert(self, force=False, retry_failed=False, overwrite=False, keep_existing=False) -> dict[str, int]:
        """Converts what has changed; returns outcomes with counts (see results). Tasks write texts under names of their own; those
        reported are renamed to their places by tasks, then the registry is written. Whoever dies before that leaves the registry as it was,
        and the next run converts again."""
        at, folder = now_ms(), self.store.get("output.dir")
        outputs, root = self.store.table("outputs"), self.root + "/"
        ext = S.extension(F.element_at(F.split("input_path", "/"), -1))
        decision = (
            F.when(F.col("src_hash").isNull(), "missing").when(~F.coalesce(ext.isin(INDEXABLE), F.lit(False)), "unsupported").when(F.col("src_size") > self.store.get("convert.size_cap_bytes"), "too_large")
            .otherwise(lifecycle.convert_decision(force, retry_failed, overwrite, keep_existing)))
        name = F.coalesce(*[F.when(ext == e, extract.extractor_name(e)) for e in INDEXABLE])
        planned = outputs.join(self._state(outputs), "input_path").withColumns({"decision": decision, "ext": ext, "by": name})
        planned = planned.withColumn("planned", F.concat(F.lit(folder + "/"), S.output_path("input_path", self.store.get("output.collision_aware_naming"))))
        planned = written(planned, "planned")
        head = F.concat(S.annotation("input_path", "src_hash", "by", F.lit(at)), F.lit("\n")) if self.store.get("output.annotate") else F.lit("")
        work = planned.where(F.col("decision").isin("convert", "conflict"))
        staging = os.path.join(self.store.home, "staging", uuid.uuid4().hex)
        made = written(extract.staged(work.select(F.col("input_path").alias("path"), "ext", F.concat(F.lit(root), "input_path").alias("full"), head.alias("head")), staging), "staged")
        done = planned.join(made.select(F.col("path").alias("input_path"), "kind", "detail", "message", "staged", F.col("out_hash").alias("new_hash")), "input_path", "left")
        target = F.concat(F.lit(root), "planned", F.when(F.col("decision") == "conflict", ".new").otherwise(""))
        moves = done.where("kind = 'ok'").select(F.col("input_path").alias("path"), "staged", target.alias("target"), F.col("new_hash").alias("out_hash"))
        if lost := extract.placed(moves).where(~F.col("placed")).count():
            raise OSError(f"{lost} converted files aren't at their places; run again")
        shutil.rmtree(staging, ignore_errors=True)
        d = F.col("decision")
        ok = (d == "convert") & (F.col("kind") == "ok")
        kept = (d == "kept_existing_output") & F.col("out_hash").isNotNull()  # a row whose output is gone stays as it is
        bad = d.isin("missing", "unsupported", "too_large")
        outcome = F.when(ok, "converted").when(d == "convert", F.col("kind")).when(d == "conflict", d).when(d == "kept_existing_output", "converted").when(bad, d).otherwise("skipped")
        done = written(done.withColumn("outcome", outcome), "converted")

        def value(column, *cases):
            out = F.col(column)
            for condition, new in reversed(cases):
                out = F.when(condition, new).otherwise(out)
            return out.alias(column)

        failed = (d == "convert") & ~ok
        changed = done.where(ok | failed | kept | bad | (d == "conflict")).select(
            "id", "input_path", value("output_path", (ok, F.col("planned"))), "added_at", F.col("outcome").alias("status"),
            value("status_detail", (ok | kept | bad, F.lit(None)), (failed, F.col("detail")), (d == "conflict", F.lit("output_modified_with_source_change"))),
            value("status_note", (failed, F.col("message")), (ok | bad, F.lit(None))), value("last_src_mtime", (ok, F.col("src_mtime"))), value("last_src_size", (ok, F.col("src_size"))),
            value("last_src_hash", (ok | kept, F.col("src_hash"))), value("last_out_hash", (ok, F.col("new_hash")), (kept, F.col("out_hash"))), value("last_converted", (ok, F.lit(at))),
            value("extractor", (ok, F.col("by"))), value("attempts", (ok, F.lit(0)), (F.col("kind") == "failed", F.col("attempts") + (d == "convert").cast("int"))), F.lit(at).alias("last_attempt"))
        results = done.select("input_path", "outcome", F.when(failed, F.col("detail")).alias("detail"), F.when(ok, F.col("planned")).otherwise(F.col("output_path")).alias("output_path"))
        self.store.append({"outputs": changed}, {"outputs": changed.select("input_path")}, {"outputs": [["input_path"], ["id"]]}, {"results": results})
        return {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}

    def results(self) -> DataFrame:
        """input_path, outcome, detail, output_path of each input of the last conversion run, by path whatever order tasks ended in."""
        return self.store.table("results").orderBy("input_path")

    def info(self) -> dict:
        """Inputs by state and by extractor, and the last conversion."""
        outputs = self.store.table("outputs")
        by = {r["extractor"]: r["count"] for r in outputs.where("extractor IS NOT NULL").groupBy("extractor").count().collect()}
        row = outputs.agg(F.count("*").alias("registered"), F.max("last_converted").alias("last_converted"), *[F.count_if(F.col("status") == s).alias(s) for s in schema.OUTPUT_STATES]).first()
        return row.asDict() | {"by_extractor": by}

    def check(self) -> dict[str, int]:
        """Breaches of the registry's invariants: converted inputs without a path or a hash, and outputs that several inputs name."""
        outputs = self.store.table("outputs")
        return {
            "converted_without_output": outputs.where((F.col("status") == "converted") & (F.col("output_path").isNull() | F.col("last_out_hash").isNull())).count(),
            "outputs_twice": outputs.where("output_path IS NOT NULL").groupBy("output_path").count().where("count > 1").count(),
        }

    def show(self, output_path: str) -> DataFrame:
        """The registry's row of an output."""
        return self.store.table("outputs").where(F.col("output_path") == output_path)

    def whence(self, path: str) -> tuple[str, str] | None:
        """(source, via) of an output: by the registry, else by the file's own annotation."""
        row = self.store.table("outputs").where(F.col("output_path") == path).select("input_path").first()
        if row:
            return row[0], "db"
        try:
            with open(os.path.join(self.root, path)) as f:
                line = f.readline().rstrip("\n")
        except OSError:
            return None
        found = self.spark.createDataFrame([(line,)], "line string").select(S.annotated_source("line")).first()[0]
        return (found, "annotation") if found else None


class CrawlVault:
    """Sources and the documents they hold, with change detection."""

    SCHEMAS = {"sources": schema.SOURCES, "runs": schema.RUNS, "documents": schema.DOCUMENTS}
    IGNORE = ".crawlignore"
    CONFIG = frozenset(("max_depth", "since_ms", "include", "exclude", "mount", "base", "drive_id", "site_hostname", "site_path", "folder", "web", "delta_links", "all_sites", "sites_query", "sites_filter", "max_sites"))

    def __init__(self, spark: SparkSession, root: str, create: bool = False) -> None:
        self.spark, self.store = spark, Store(spark, root, self.SCHEMAS, create)

    @writes
    def add_source(self, name: str, uri: str, kind: str = "local", strategy: str | None = None, **config) -> None:
        """Kinds and strategies go by any of their names. config: max_depth, since_ms, include, exclude (globs) and mount of this
        source alone, and of a library drive_id or site_hostname and site_path, folder, or web; a run's own arguments go first."""
        kind, strategy = schema.named(kind, schema.KINDS), schema.named(strategy or self.store.get("crawl.default_strategy"), schema.STRATEGIES)
        if unknown := config.keys() - self.CONFIG:
            raise ValueError(f"no such setting of a source: {', '.join(sorted(unknown))}")
        sources = self.store.table("sources")
        new = self.spark.createDataFrame([(None, name, kind, uri, strategy, json.dumps(config), True, now_ms(), None, None, None, None)], schema.SOURCES)
        top = sources.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        self.store.commit({"sources": sources.unionByName(new.withColumn("id", F.lit(top).cast("long")))}, {"sources": [["name"], ["id"]]})

    @writes
    def remove_source(self, name: str) -> bool:
        """With its documents and runs."""
        sources, docs, runs = (self.store.table(t) for t in ("sources", "documents", "runs"))
        gone = sources.where(F.col("name") == name).select(F.col("id").alias("source_id"))
        if not gone.count():
            return False
        self.store.commit({"sources": sources.where(F.col("name") != name), "documents": docs.join(gone, "source_id", "left_anti").select(*docs.columns), "runs": runs.join(gone, "source_id", "left_anti").select(*runs.columns)})
        return True

    @writes
    def enable(self, name: str, on: bool = True) -> None:
        s = self.store.table("sources")
        self.store.commit({"sources": s.withColumn("enabled", F.when(F.col("name") == name, F.lit(on)).otherwise(F.col("enabled")))})

    @staticmethod
    def plan(source, globs_=None, since_ms: int | None = None, default_depth: int = 0) -> dict:
        """Depth, time and globs by strategy (recursive, shallow, incremental since the last attempt, or targeted), the run's own
        arguments, the source's config and the default depth, in this order."""
        s = source["strategy"]
        own = json.loads(source["config"] or "{}") if "config" in source else {}
        since = next((x for x in (since_ms, source["last_crawled"] if s == "incremental" else None, own.get("since_ms")) if x is not None), None)
        include = globs_ or own.get("include") or (["**/*"] if s == "targeted" else [])
        return {"max_depth": 1 if s == "shallow" else (own.get("max_depth") or default_depth or None), "since_ms": since, "include": include, "exclude": own.get("exclude") or [], "mount": own.get("mount")}

    @writes
    def discover(self, names: list[str] | None = None, globs_: list[str] | None = None, since_ms: int | None = None, hashing: bool | None = None, dry_run: bool = False, items: DataFrame | None = None, fetch: graph.Fetch | None = None) -> dict[str, dict]:
        """Runs sources: lists, filters, merges with their documents and records the run. items takes a listing from elsewhere; fetch
        gives a library's pages by address. An incremental run of a library goes on from the link where its last one ended. hashing
        follows the setting crawl.hash. After a run with errors nothing is marked as gone: what couldn't be listed may still be there."""
        reports, hashing = {}, self.store.get("crawl.hash") if hashing is None else hashing
        for src in self.store.table("sources").where("enabled").orderBy("name").collect():
            if names and src["name"] not in names:
                continue
            p, at = self.plan(src.asDict(), globs_, since_ms, self.store.get("crawl.default_max_depth")), now_ms()
            docs, runs, sources = (self.store.table(t) for t in ("documents", "runs", "sources"))
            run_id = runs.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
            try:
                errors: list[str] = []
                found, remember = (items, {}) if items is not None else self._listed(src, p, fetch, errors)
            except (local.Unreachable, OSError) as e:
                run = self.spark.createDataFrame([(run_id, src["id"], src["strategy"], at, now_ms(), 0, 0, 0, 0, 1, "error", str(e))], schema.RUNS)
                self.store.commit({"runs": runs.unionByName(run), "sources": self._noted(sources, src["id"], {"last_crawled": at, "last_status": "error", "last_error": str(e)})})
                reports[src["name"]] = {"status": "error"}
                continue
            seen = local.kept(found, schema.DOCUMENT_EXTENSIONS, (), p["include"], p["exclude"], None if remember else p["since_ms"]).dropDuplicates(["uri"])
            if hashing and items is None:
                digest = self._hashes(seen)
                seen = seen.join(digest, "uri", "left").withColumn("content_hash", F.coalesce("content_hash", "h")).drop("h")
            seen = seen.persist()
            mine = docs.where(F.col("source_id") == src["id"])
            full = p["since_ms"] is None and not p["max_depth"] and not errors
            merged = lifecycle.crawl_merge(seen.select("uri", "size", "modified_ms", "content_hash"), mine, self.store.get("documents.size_cap_bytes"), full).persist()
            report = lifecycle.tally(merged, "outcome", ["discovered", "updated", "gone"]).first().asDict()
            report["skipped"] = found.count() - seen.count()
            reports[src["name"]] = report
            if not dry_run:
                new = merged.withColumnRenamed("status", "m_status").withColumnRenamed("content_hash", "m_hash")
                s = seen.select(*[F.col(c).alias(f"s_{c}") for c in ("uri", "name", "rel_path", "extension", "size", "modified_ms")])
                m = mine.withColumnRenamed("uri", "d_uri")
                rows = new.join(s, F.col("uri") == F.col("s_uri"), "left").join(m, F.col("uri") == F.col("d_uri"), "left")
                was, touched = F.col("d_uri").isNotNull(), F.col("s_uri").isNotNull()
                new_id = F.xxhash64(F.lit(src["id"]), "uri").bitwiseAND(2**62 - 1)
                reached = touched | F.col("outcome").isNotNull()
                rows = rows.select(
                    F.coalesce("id", new_id).alias("id"), F.lit(src["id"]).cast("long").alias("source_id"), "uri",
                    *[F.coalesce(f"s_{c}", c).alias(c) for c in ("name", "rel_path", "extension")],
                    *[F.when(touched, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "modified_ms")],
                    F.col("m_hash").alias("content_hash"), "metadata", F.col("m_status").alias("status"), "status_note",
                    F.when(was, F.col("discovered_at")).otherwise(F.lit(at)).alias("discovered_at"),
                    F.when(was, F.col("first_run_id")).otherwise(F.lit(run_id)).cast("long").alias("first_run_id"),
                    F.when(touched, F.lit(at)).otherwise(F.col("last_seen")).alias("last_seen"),
                    F.when(reached, F.lit(run_id)).otherwise(F.col("last_run_id")).cast("long").alias("last_run_id"))
                status = "partial" if errors else "ok"
                did = (report["discovered"], report["updated"], report["gone"], report["skipped"], len(errors))
                run = self.spark.createDataFrame([(run_id, src["id"], src["strategy"], at, now_ms(), *did, status, "; ".join(errors[:5]) or None)], schema.RUNS)
                config = json.dumps(json.loads(src["config"] or "{}") | remember)
                noted = self._noted(sources, src["id"], {"last_crawled": at, "last_run_id": run_id, "last_status": status, "last_error": None, "config": config})
                tables = {"documents": docs.where(F.col("source_id") != src["id"]).unionByName(rows), "runs": runs.unionByName(run), "sources": noted}
                self.store.commit(tables, {"documents": [["source_id", "uri"], ["id"]], "runs": [["id"]]})
            merged.unpersist()
            seen.unpersist()
        return reports

    @staticmethod
    def _noted(sources: DataFrame, id_: int, values: dict) -> DataFrame:
        """The sources, with new values in the columns of one."""
        this, kinds = F.col("id") == id_, dict(sources.dtypes)
        return sources.withColumns({c: F.when(this, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})

    def _listed(self, src, p: dict, fetch: graph.Fetch | None, errors: list[str]) -> tuple[DataFrame, dict]:
        """A source's items by its kind, and what its configuration must remember."""
        def folder(root):
            return local.items(self.spark, root, max_depth=p["max_depth"], follow_links=self.store.get("crawl.follow_symlinks"), ignore_lines=ignore_lines(root, self.IGNORE), errors=errors), {}

        def paged():
            if fetch is None:
                raise local.Unreachable(f"{src['uri']}: pass a fetch callable, or the library's listing as items")
            return graph.discovered(self.spark, fetch, json.loads(src["config"] or "{}"), p["max_depth"], src["strategy"] == "incremental", errors)

        kinds = {"local": lambda: folder(local.root_of(src["uri"])), "smb": lambda: folder(local.mount_of(src["uri"], p["mount"])), "library": paged}
        return kinds[src["kind"]]()

    @staticmethod
    def _hashes(seen: DataFrame) -> DataFrame:
        """uri, h: hashes of the files, by tasks; null where one can't be read."""
        def run(batches):
            import pandas as pd

            for b in batches:
                yield pd.DataFrame({"uri": b["uri"], "h": [extract.hashed(u) for u in b["uri"]]})

        return seen.select("uri").mapInPandas(run, "uri string, h string")

    @writes
    def remove_uris(self, uris: list[str]) -> int:
        """Unregisters documents by their uris, in every source."""
        d = self.store.table("documents")
        wanted = self.spark.createDataFrame([(u,) for u in uris], "uri string")
        n = d.join(wanted, "uri", "left_semi").count()
        self.store.commit({"documents": d.join(wanted, "uri", "left_anti").select(*d.columns)})
        return n

    def find(self, text: str, limit: int = 50) -> DataFrame:
        """Documents whose name or uri holds text, in any case."""
        return self.ls(like=text, limit=limit)

    def check(self) -> dict[str, int]:
        """Breaches of the registry's invariants: documents without a source, documents twice in one, runs without a source."""
        docs, sources, runs = (self.store.table(t) for t in ("documents", "sources", "runs"))
        ids = sources.select(F.col("id").alias("source_id"))
        return {
            "documents_without_source": lifecycle.orphans(docs, ids, "source_id").count(), "runs_without_source": lifecycle.orphans(runs, ids, "source_id").count(),
            "documents_twice": docs.groupBy("source_id", "uri").count().where("count > 1").count(),
        }

    def info(self) -> DataFrame:
        """name, n_documents, last_status, last_error of every source; counts go before the join."""
        counts = self.store.table("documents").groupBy("source_id").agg(F.count("*").alias("n"))
        s = self.store.table("sources")
        return s.join(counts, F.col("id") == F.col("source_id"), "left").select("name", "kind", "uri", F.coalesce("n", F.lit(0)).alias("n_documents"), "last_status", "last_error").orderBy("name")

    def ls(self, status=None, extension=None, like=None, limit: int | None = None) -> DataFrame:
        d = self.store.table("documents")
        d = d.where(F.col("status") == status) if status else d
        d = d.where(F.col("extension") == extension.lower()) if extension else d
        if like:
            pattern = f"%{like.lower()}%".replace("\\", "\\\\")
            d = d.where(F.lower("name").like(pattern) | F.lower("uri").like(pattern))
        d = d.orderBy(F.lower("name"), "uri")
        return d.limit(limit) if limit else d

    @writes
    def prune(self, status: str = "gone", dry_run: bool = False) -> int:
        d = self.store.table("documents")
        n = d.where(F.col("status") == status).count()
        if n and not dry_run:
            self.store.commit({"documents": lifecycle.pruned(d, status)})
        return n

    def sources(self, name: str | None = None) -> DataFrame:
        """The sources by name, or one of them."""
        s = self.store.table("sources")
        return (s if name is None else s.where(F.col("name") == name)).orderBy("name")

    def show(self, uri: str) -> DataFrame:
        """The documents of a uri, one a source."""
        return self.store.table("documents").where(F.col("uri") == uri)

    def status(self) -> dict:
        """Documents by state and in all, those first seen by the last run of their source, sources, those enabled, and `per_source`: a
        source each with its documents and last run."""
        docs, sources = self.store.table("documents"), self.store.table("sources")
        of = lifecycle.tally(docs, "status", list(schema.DOCUMENT_STATES)).first().asDict()
        counts = docs.groupBy("source_id").agg(F.count("*").alias("documents"))
        each = [r.asDict() for r in sources.join(counts, F.col("id") == F.col("source_id"), "left").select("name", "kind", "uri", "strategy", "enabled", F.coalesce("documents", F.lit(0)).alias("documents"), "last_crawled", "last_status").orderBy("name").collect()]
        return of | {"documents": docs.count(), "new_last_run": lifecycle.new_in_last_run(docs, sources).count(), "sources": len(each), "sources_enabled": sum(s["enabled"] for s in each), "per_source": each}

    def fetch(self, out: str, get: library.Bytes | None = None, tasks: int = 4, per_second: float = 10.0) -> dict:
        """Copies live documents to <out>/<source>/<path>, where size differs, by tasks: those of local and mounted sources from
        where they lie, those of libraries by get (see library.downloaded). Returns counts, bytes, and both `per_source`."""
        live = self.store.table("documents").where(F.col("status").isin("present", "modified"))
        of = self.store.table("sources").select(F.col("id").alias("source_id"), S.sanitized_source("name").alias("source"), "kind", "config")
        to = F.concat(F.lit(out.rstrip("/") + "/"), "source", F.lit("/"), F.coalesce("rel_path", "name"))
        todo = live.join(of, "source_id").select("source", "kind", "config", "uri", to.alias("to"), "size")
        far = todo.where("kind = 'library'").withColumn("address", library.download_address(F.col("config"), F.col("uri")))
        near = todo.where("kind <> 'library'").withColumn("address", F.col("uri"))
        done = library.downloaded(near, None, self.spark.sparkContext.defaultParallelism, float("inf"), 1)
        if get is not None:
            done = done.unionByName(library.downloaded(far, get, tasks, per_second))
        else:
            done = done.unionByName(far.select("source", F.lit("errors").alias("outcome"), F.lit(0).cast("long").alias("bytes")))
        rows = done.groupBy("source", "outcome").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
        per = {}
        for r in rows:
            one = per.setdefault(r["source"], {"fetched": 0, "skipped": 0, "errors": 0, "bytes": 0})
            one[r["outcome"]] += r["n"]
            one["bytes"] += r["bytes"]
        return {k: sum(x[k] for x in per.values()) for k in ("fetched", "skipped", "errors", "bytes")} | {"per_source": per}

    def export(self, form: str = "paths") -> DataFrame:
        """One column `line`: uris, JSON rows, or CSV lines with the source's name."""
        d = self.store.table("documents").where(F.col("status").isin("present", "modified"))
        if form == "paths":
            return d.select(F.col("uri").alias("line"))
        if form == "jsonl":
            return d.select(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("line"))
        named = d.join(self.store.table("sources").select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left").withColumn("source", F.coalesce("source", F.col("source_id").cast("string")))
        return named.select(F.concat_ws(",", *[F.coalesce(S.csv_escaped(c), F.lit("")) for c in ("name", "extension", "size", "modified_ms", "status", "source", "uri")]).alias("line"))
