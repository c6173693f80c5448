"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import ascii_lower, materialize, separated

#: What stands between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle, the token of the join.
SHINGLE = 3
#: Rows of benchmark windows or shingles that are broadcast at once; more go in as many blocks, each over all documents.
BLOCK_ROWS = 200_000


def words(text):
    return separated(ascii_lower(F.col(text)), SEPARATORS)


def windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, w (array of words): every run of `window` words; an item of fewer, but not none, is one window."""
    w = items.select("item_id", words("text").alias("ws"))
    starts = F.when(F.size("ws") > 0, F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1))))
    return w.select("item_id", "ws", F.explode(starts).alias("at")).select("item_id", F.slice("ws", F.col("at"), window).alias("w")).distinct()


def hits(docs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Places in docs (doc_id, text_key, ws) whose k words hash to a row of table (h, ...), which is broadcast: its size was checked.
    Texts of fewer words have no places; the generator sees to it, as a filter would be pushed below the split and repeat it."""
    places = F.when(F.size("ws") >= k, F.sequence(F.lit(0), F.size("ws") - k))
    at = docs.select("doc_id", "text_key", "ws", F.explode(places).alias("at"))
    at = at.withColumn("h", F.xxhash64(*[F.get(F.col("ws"), F.col("at") + i) for i in range(k)]))
    return at.join(F.broadcast(table), "h")


def blocks(table: DataFrame, n: int, key: str):
    """table in parts of about BLOCK_ROWS rows by a hash of key."""
    count = max(1, -(-n // BLOCK_ROWS))
    return [table] if count == 1 else [table.where(F.pmod(F.hash(key, F.lit(7)), F.lit(count)) == i) for i in range(count)]


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is an item's `window` consecutive words (a shorter item, if not empty, is one). Its prefix is its rarest
    shingle of SHINGLE words, by occurrences in all of docs: as the window is wanted whole, one token is prefix
    enough. A document's places with that shingle are lined up with the window (a document shorter than the window,
    or a place where it would stick out, is no candidate) and compared word by word. n_hit counts the words inside
    any match; contaminated: n_hit > 0 and share * n_hit >= n_words.

    Null texts have no words; null and repeated doc_ids are kept, rows of equal doc_id and text are judged alike; items
    without words match nothing; a null item_id hits words but is no item of n_items and items_sha256, which has no name
    for it; empty tables give no rows or no hits. Documents are never shuffled or exploded into shuffled rows: each pass
    reads them, and the distinct windows, in blocks of a fixed number of rows, are broadcast. Which items hold a window is
    joined to its matches alone."""
    held = materialize(windows(items, window), "held")
    wins = materialize(held.groupBy("w").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("w_id"), "w", F.size("w").alias("len")), "windows")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words("text").alias("ws"))
    lengths = [(r["k"], r["n"]) for r in wins.select(F.least("len", F.lit(SHINGLE)).alias("k"), (F.col("len") - F.least("len", F.lit(SHINGLE)) + 1).alias("places")).groupBy("k").agg(F.sum("places").alias("n")).collect()]  # SHINGLE rows at most
    found = None
    for k, n in sorted(lengths):
        own = wins.where(F.least("len", F.lit(SHINGLE)) == k)
        shingled = own.select("w_id", "w", "len", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
        shingled = shingled.withColumn("h", F.xxhash64(*[F.get(F.col("w"), F.col("off") + i) for i in range(k)]))
        counted = None
        for part in blocks(shingled.select("h").distinct(), n, "h"):
            c = hits(keyed, part, k).groupBy("h").agg(F.count("*").alias("df"))
            counted = c if counted is None else counted.unionByName(c)
        rarity = materialize(counted, "rarity")
        rarest = Window.partitionBy("w_id").orderBy("df", "h", "off")
        prefix = shingled.join(rarity, "h").withColumn("r", F.row_number().over(rarest)).where("r = 1")
        # A window of which some shingle occurs nowhere matches nothing; it needs no prefix.
        missing = shingled.join(rarity, "h", "left_anti").select("w_id").distinct()
        prefix = materialize(prefix.join(missing, "w_id", "left_anti").select("w_id", "w", "len", "off", "h"), "prefix")
        for part in blocks(prefix, n, "w_id"):
            start = F.col("at") - F.col("off")
            m = hits(keyed, part, k).where((start >= 0) & (start + F.col("len") <= F.size("ws")))
            m = m.where(F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("w"))
            m = m.select("doc_id", "text_key", "w_id", start.alias("start"), (start + F.col("len")).alias("end"))
            found = m if found is None else found.unionByName(m)
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words("text")).cast("long").alias("n_words"))
    if found is None:
        judged = sizes.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "ids": F.array().cast("array<string>")})
    else:
        found = materialize(found.distinct(), "found")
        of = ["doc_id", "text_key"]
        # Words covered: what each match adds beyond the furthest end before it. Rows of one document only meet.
        ordered = Window.partitionBy(*of).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        spans = found.select(*of, "start", "end").distinct().withColumn("before", F.coalesce(F.max("end").over(ordered), F.lit(0)))
        covered = spans.groupBy(*of).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))).cast("long").alias("n_hit"))
        names = wins.select("w_id", "w").join(held.where("item_id is not null"), "w").select(F.col("w_id").alias("h_id"), F.col("item_id").cast("string").alias("item"))
        named = found.select(*of, "w_id").distinct().join(names, F.col("w_id") == F.col("h_id")).select(*of, "item").distinct().groupBy(*of).agg(F.sort_array(F.collect_list("item")).alias("ids"))
        matched = materialize(covered.join(named, [covered[c].eqNullSafe(named[c]) for c in of], "left").select(covered["doc_id"].alias("m_id"), covered["text_key"].alias("m_key"), "n_hit", "ids"), "matched")
        judged = sizes.join(matched, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
        judged = judged.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "ids": F.coalesce("ids", F.array().cast("array<string>"))})
        judged = judged.withColumn("n_items", F.size("ids").cast("long"))
    return judged.select(
        "doc_id", "text_key", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones, columns unchanged."""
    bad = contamination(docs.select("doc_id", "text"), items, **how).where("contaminated").select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))  # whatever other columns are called
    return rows.join(bad, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("key") == F.col("b_key")), "left_anti").select("row.*")
