"""The catalogue: every query applies operators of the engine to whole tables. Its SQL counterparts are in oracles.py."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions import globs
from quillmere.functions import scalars as S
from quillmere.operators import chunking, lifecycle, search, text_index

QUERIES = {}
# The query vector is that of this row, the query words are these.
QUERY_VECTOR, TERMS = 7, "the and"


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probe(vectors: DataFrame) -> list[float]:
    row = vectors.where(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()
    return list(row[0]) if row else [0.0]


def files(spark, sf_dir) -> DataFrame:
    """Documents as registered files: a path by source, sizes and times by their own numbers."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("md", "txt", "json", "bin"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    states = F.element_at(F.array(*map(F.lit, ("indexed", "failed", "pending", "missing"))), (F.pmod("doc_id", F.lit(8)) / 2 + 1).cast("int"))
    return d.select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit("."), ext).alias("path"), ext.alias("ext"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 11 != 0).alias("exists"), (F.col("doc_id") % 13 != 0).alias("is_file"), (F.col("doc_id") * 1000).alias("mtime"), states.alias("status"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 1000).alias("last_mtime"), F.octet_length("text").cast("long").alias("last_size"))


# The SQL of the keyword queries cuts texts into ASCII runs; the queries named _unicode search as the engine does.


def keyword(spark, sf_dir, unicode=False):
    return text_index.bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), TERMS, unicode=unicode)


@query
def keyword_bm25_topk(spark, sf_dir, **how):
    return text_index.top(keyword(spark, sf_dir, **how), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query
def keyword_bm25_all_terms(spark, sf_dir, **how):
    return keyword(spark, sf_dir, **how).select("doc_id", F.round("score", 6).alias("score"))


@query
def vector_knn_l2(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.knn(v, "vec_id", "embedding", probe(v), 20).select("vec_id", F.round("distance", 5).alias("distance"))


def hybrid(spark, sf_dir, unicode=False, **how):
    docs, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    v = v.select(F.col("vec_id").alias("doc_id"), "embedding")
    e = list(probe(v.withColumnRenamed("doc_id", "vec_id")))
    out = search.search(docs, v, TERMS, e, id_col="doc_id", path="source", text=F.col("text"), unicode=unicode, **how)
    return out.select("doc_id", "vector_rank", "keyword_rank", F.round("score", 9).alias("score"))


@query
def hybrid_rrf(spark, sf_dir, **how):
    return hybrid(spark, sf_dir, **how)


@query
def hybrid_rrf_filtered(spark, sf_dir, **how):
    return hybrid(spark, sf_dir, path_glob="src1*", **how)


@query
def search_threshold(spark, sf_dir, **how):
    return hybrid(spark, sf_dir, threshold=0.0150, **how)


@query
def vector_only_rrf(spark, sf_dir):
    return hybrid(spark, sf_dir, mode="vector")


@query
def keyword_only_rrf(spark, sf_dir, **how):
    return hybrid(spark, sf_dir, mode="keyword", **how)


QUERIES |= {f"{f.__name__}_unicode": functools.partial(f, unicode=True) for f in (keyword_bm25_topk, keyword_bm25_all_terms, hybrid_rrf, hybrid_rrf_filtered, search_threshold, keyword_only_rrf)}


@query
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.sha256_hex("text").alias("content_hash"))


@query
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.token_estimate("text").alias("tokens"))


@query
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.sentences("text")).alias("n_sentences"))


@query
def chunk_greedy_pack(spark, sf_dir):
    return chunking.greedy(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("doc_id", "ordinal", S.sha256_hex("content").alias("content_hash"))


@query
def chunk_pack_summed(spark, sf_dir):
    """As the chunker packs: the estimates of both parts are added. chunk_greedy_pack counts the joined text."""
    return chunking.greedy(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), summed=True).select("doc_id", "ordinal", S.sha256_hex("content").alias("content_hash"))


@query
def chunk_ordinals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).select("doc_id", "ordinal", S.sha256_hex("line").alias("line_hash"))


@query
def chunk_overlap(spark, sf_dir):
    """The last 200 bytes of the paragraph before, from the start of a character, of all texts."""
    return chunking.overlaps(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query
def chunk_documents(spark, sf_dir):
    """Sections, packing and overlap of all documents; no SQL, held against a chunker of the tests' own."""
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query
def heading_paths(spark, sf_dir):
    """Each heading of a page with the headings it stands under."""
    p = table(spark, sf_dir, "pages")
    tag = r"(?s)<h([1-6])>(.*?)</h[1-6]>"
    h = p.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("l"), F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("t"))).alias("at", "h"))
    h = h.select("page_id", "at", F.col("h.l").cast("int").alias("level"), F.regexp_replace("h.t", r"<[^>]*>", "").alias("title"))
    w = Window.partitionBy("page_id").orderBy("at")
    for i in range(1, 7):  # the last heading of each level, if none of a wider level came after it
        h = h.withColumn(f"at{i}", F.max(F.when(F.col("level") == i, F.col("at"))).over(w)).withColumn(f"t{i}", F.last(F.when(F.col("level") == i, F.col("title")), True).over(w))
    parts = []
    for i in range(1, 7):
        wider = F.greatest(*[F.coalesce(f"at{j}", F.lit(-1)) for j in range(1, i)], F.lit(-1), F.lit(-1))
        parts.append(F.when((F.col("level") >= i) & (F.col(f"at{i}") > wider), F.col(f"t{i}")))
    return h.select("page_id", "at", F.concat_ws(" > ", *parts).alias("heading_path"))


@query
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(S.sha256_hex("text").alias("content_hash")).agg(F.count("*").alias("n_docs")).where("n_docs > 1")


@query
def status_classify(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", lifecycle.index_decision(["md", "txt", "json"], ["json"], 8000).alias("decision"))


@query
def status_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_files"))


@query
def status_summary_pivot(spark, sf_dir):
    decided = files(spark, sf_dir).select(lifecycle.index_decision(["md", "txt", "json"], ["json"], 8000).alias("decision"))
    return lifecycle.tally(decided, "decision", ["missing", "failed", "unsupported", "excluded", "too_large", "skipped", "work"])


def conversions(spark, sf_dir):
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("converted", "failed", "conflict", "pending"))), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), S.sha256_hex("text").alias("src_hash"), F.when(i % 5 == 0, None).when(i % 3 == 0, F.lit("old")).otherwise(S.sha256_hex("text")).alias("last_src_hash"), F.when(i % 7 != 0, F.lit("out")).alias("out_hash"), F.when(i % 2 == 0, "out").otherwise("edited").alias("last_out_hash"))


@query
def convert_decision(spark, sf_dir):
    return conversions(spark, sf_dir).select("doc_id", lifecycle.convert_decision().alias("decision"), lifecycle.convert_decision(force=True).alias("forced"), lifecycle.convert_decision(overwrite=True).alias("overwritten"), lifecycle.convert_decision(keep_existing=True).alias("kept"))


def crawled(spark, sf_dir):
    """Two runs over documents: the first saw those not divisible by 3, the second those not by 5, some of them changed."""
    d = table(spark, sf_dir, "documents")
    i, uri = F.col("doc_id"), F.concat(F.lit("file:/"), "source", F.lit("/"), "doc_id").alias("uri")
    old = d.where(i % 3 != 0).select(uri, F.col("n_chars").alias("size"), (i * 10).alias("modified_ms"), F.lit("h").alias("content_hash"), F.when(i % 17 == 0, "gone").otherwise("present").alias("status"))
    new = d.where(i % 5 != 0).select(uri, F.col("n_chars").alias("size"), F.when(i % 4 == 0, i * 10 + 1).otherwise(i * 10).alias("modified_ms"), F.when(i % 6 != 0, "h").alias("content_hash"))
    return new, old


@query
def crawl_upsert(spark, sf_dir):
    return lifecycle.crawl_merge(*crawled(spark, sf_dir), cap=9000)


@query
def crawl_gone(spark, sf_dir):
    return lifecycle.crawl_merge(*crawled(spark, sf_dir)).where("outcome = 'gone'").select("uri")


@query
def crawl_report(spark, sf_dir):
    return lifecycle.tally(lifecycle.crawl_merge(*crawled(spark, sf_dir), cap=9000), "outcome", ["discovered", "updated", "gone"])


@query
def crawl_shallow(spark, sf_dir):
    """A run that doesn't enumerate all marks nothing gone."""
    return lifecycle.tally(lifecycle.crawl_merge(*crawled(spark, sf_dir), full=False), "outcome", ["discovered", "updated", "gone"])


@query
def crawl_incremental_since(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    since = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("since"))
    return e.join(F.broadcast(since)).where("ts >= since").groupBy("event_type").agg(F.count("*").alias("n_events"))  # since: one row


@query
def new_in_last_run(spark, sf_dir):
    """Users whose first and last events fall within thirty days."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    return e.where("datediff(last, first) <= 30").select("user_id")


@query
def orphan_check(spark, sf_dir):
    return lifecycle.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").agg(F.count("*").alias("orphans"))


@query
def consistency_checks(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    twice = d.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("check_name", F.lit("duplicate_ids"))
    lost = lifecycle.orphans(l, d, "doc_id").agg(F.count("*").alias("n")).withColumn("check_name", F.lit("orphan_labels"))
    dead = lifecycle.orphans(l, d, "doc_id", F.col("n_chars") > 100).agg(F.count("*").alias("n")).withColumn("check_name", F.lit("labels_of_short"))
    return twice.unionByName(lost).unionByName(dead)


@query
def untracked(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query
def paths_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query
def find_substring(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.lower("url").like("%example.com/%")).orderBy(F.lower("url"), "page_id").select("page_id", "url")


@query
def ext_filter(spark, sf_dir):
    return files(spark, sf_dir).where(globs.ext_ok(F.col("ext"), ["md", "TXT", "json"], ["json"])).select("doc_id", "ext")


@query
def glob_filter(spark, sf_dir):
    p = files(spark, sf_dir)
    return p.where(globs.path_ok(F.col("path"), F.col("ext"), ["src1*/*.md", "**/*.txt"], ["src?/*5.*"])).select("doc_id", "path")


@query
def ignore_filter(spark, sf_dir):
    p = files(spark, sf_dir)
    return p.where(~globs.ignored(F.col("path"), ["*.bin", "src1/", "!src1/*.md"])).select("doc_id", "path")


@query
def ignore_patterns(spark, sf_dir):
    """Folders anywhere, any number of components, classes and a file kept by a later rule, over all documents' paths."""
    p = files(spark, sf_dir)
    rules = ["**/src2", "src1/**/*1.md", "*.tx[st]", "!src2/*5.txt", r"\#none", "src4/", "src3?/"]
    return p.where(~globs.ignored(F.col("path"), rules)).select("doc_id", "path")


@query
def new_documents_of_last_run(spark, sf_dir):
    """Documents of each source that its last run was the first to see; a document's first run is its length modulo nine."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), F.pmod("n_chars", F.lit(9)).alias("first_run_id"))
    sources = d.groupBy(F.col("source_id").alias("id")).agg(F.max("first_run_id").alias("last_run_id"))
    return lifecycle.new_in_last_run(d, sources).select("doc_id", "source_id", F.col("first_run_id").cast("long").alias("first_run_id"))


@query
def ls_dynamic_filter(spark, sf_dir):
    f = files(spark, sf_dir).where("status = 'indexed'").where(F.lower("ext") == "md")
    return f.orderBy(F.lower("path"), "doc_id").limit(50).select("doc_id", "path")


@query
def export_paths(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("status").isin("indexed", "pending")).select("path")


@query
def export_csv_lines(spark, sf_dir):
    """Whole values, nulls as empty cells."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws(",", *[F.coalesce(S.csv_escaped(c), F.lit("")) for c in ("doc_id", "text", "lang", "source", "n_chars")]).alias("line"))


@query
def export_jsonl(spark, sf_dir):
    """Whole rows, texts included."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"), {"ignoreNullFields": "false"}).alias("line"))


@query
def source_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    toxic = d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))
    return d.select("source").distinct().join(toxic, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_toxic"))


@query
def run_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars")).select(F.coalesce("source", F.lit("total")).alias("source"), "n_docs", "chars")


@query
def last_seen(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query
def needs_ocr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.needs_ocr("text").alias("needs_ocr"))


@query
def frontmatter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("---\ntitle: \""), "source", F.lit("\"\nlang: "), "lang", F.lit("\n---\n"), "text").alias("md"))
    m = S.frontmatter("md")
    return d.select("doc_id", m["title"].alias("title"), m["lang"].alias("lang"), S.sha256_hex(S.frontmatter_body("md")).alias("body_hash"))


@query
def span_strip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('<span id="x">'), "source", F.lit("</span> and <span>"), "lang", F.lit("</span>")).alias("t"))
    return d.select("doc_id", S.strip_spans("t").alias("plain"))


@query
def annotation_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.annotation(F.concat("source", F.lit(" dir/"), "doc_id"), S.sha256_hex("text"), F.lit("markdown"), F.col("doc_id") * 1000).alias("line"))
    return d.select("doc_id", "line", S.annotated_source("line").alias("parsed"))


@query
def output_path(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", S.output_path("path").alias("aware"), S.output_path("path", False).alias("plain"), S.extension("path").alias("ext"), S.file_stem("path").alias("stem"))


@query
def sanitize_source(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.sanitized_source("url").alias("clean"))


@query
def server_rel_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.server_path("url").alias("path"))


@query
def display_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.human_size(F.col("n_chars") * 37).alias("size"), S.time_text(F.col("doc_id") * 86_400_000).alias("at"), S.preview("text").alias("preview"), S.truncated("source", 4).alias("short"))


@query
def whence(spark, sf_dir):
    """The registry's source of an output, else its annotation's."""
    f = files(spark, sf_dir)
    db = f.where("doc_id % 2 = 0").select(F.col("doc_id").alias("r_id"), F.col("path").alias("db_source"))
    noted = f.select("doc_id", S.annotated_source(S.annotation("path", F.lit("0123456789abcdef"), F.lit("md"), F.lit(0))).alias("noted"))
    both = noted.join(db, F.col("doc_id") == F.col("r_id"), "left")
    return both.select("doc_id", F.coalesce("db_source", "noted").alias("source"), F.when(F.col("db_source").isNotNull(), "db").otherwise("annotation").alias("via"))


@query
def prune_report(spark, sf_dir):
    return lifecycle.prune_report(files(spark, sf_dir), all_but="indexed")


@query
def add_report(spark, sf_dir):
    f = files(spark, sf_dir)
    return lifecycle.added(f.where("doc_id % 2 = 0"), f).groupBy("outcome").agg(F.count("*").alias("n"))
