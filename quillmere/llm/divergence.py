"""Source divergence audit: how far the term distributions of a language's sources lie apart, by inclusion and exclusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import UPPER, binary_texts, discard, materialize, recoded, slices, split_words

#: Documents of its language that a term needs, what is added to each count, and what shares are multiples of.
LEAST, PRIOR, SCALE = 30, 5, 1_000_000_000
#: Terms reported of a group, and the parts a group's terms are ranked in first.
TOP, SALTS = 50, 64
# Bytes of terms: letters of ASCII, of which capitals become small ones, and all bytes of other characters. All else is a space.
TERM = np.array([b + 32 if chr(b) in UPPER else b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group and documents that hold it; a null term with
    zeros for every group. Nulls are empty strings. Slices of texts are counted before anything is shuffled."""

    def count(batches):
        for batch in batches:
            for at, k in slices(batch.column("text")):
                codes, terms, offsets = split_words(recoded(binary_texts(batch.column("text").slice(at, k)), TERM.__getitem__), False)
                langs, sources = (batch.column(c).slice(at, k).fill_null("").dictionary_encode() for c in ("lang", "source"))
                group = np.asarray(langs.indices, dtype=np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
                groups, group = np.unique(group, return_inverse=True)
                each = max(1, len(terms))
                held, n = np.unique(np.repeat(np.arange(k), np.diff(offsets)) * each + codes, return_counts=True)
                key, of = np.unique(group[held // each] * each + held % each, return_inverse=True)
                whose = np.r_[groups[key // each], groups]
                named = pa.concat_arrays([terms.take(pa.array(key % each)).cast(pa.string()), pa.nulls(len(groups), pa.string())])
                none = np.zeros(len(groups), np.int64)
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(whose // len(sources.dictionary))), sources.dictionary.take(pa.array(whose % len(sources.dictionary))), named,
                    pa.array(np.r_[np.bincount(of, n, len(key)).astype(np.int64), none]), pa.array(np.r_[np.bincount(of, minlength=len(key)).astype(np.int64), none])], names=["lang", "source", "term", "n", "docs"])

    texts = docs.select(F.col("text").cast("string").alias("text"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source")))
    parts = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str = "terms") -> F.Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) in whole numbers; null where a language keeps no term."""
    return F.expr(f"1 + (CAST({n} + {PRIOR} AS DECIMAL(20, 0)) * {SCALE}) div nullif(CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0)), 0)")


def postings(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of the terms that stand in `least` documents of their language or more: (posts, groups). posts: lang, source, term,
    n, p, q, zero for each group that has the term, with the group's and the language's share, and the group's share of a
    term it lacks. groups: lang, source, terms (kept ones of the language), zero for every group."""
    counts = materialize(term_counts(docs), "terms")
    of = Window.partitionBy("lang", "term")
    kept = counts.where(F.col("term").isNotNull()).withColumns({"held": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "head": F.min("source").over(of)})
    kept = materialize(kept.where(F.col("held") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("head") == F.col("source")).cast("long").alias("head")), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    whole = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(sums, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    groups = materialize(groups.withColumn("zero", share("0L", "total")), "groups")
    posts = kept.join(groups.drop("heads"), ["lang", "source"]).select("lang", "source", "term", "n", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"), "zero")
    posts = materialize(posts, "posts")
    discard(counts, kept)
    return posts, groups.select("lang", "source", "terms", "zero")


def distances(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for each two groups of a language the sum over all kept terms of their shares' distance, once
    each way. Where neither has a term the distance is that of their two shares of nothing, so all terms are first taken as
    such. Terms of one are put right by its histogram of counts, which the other's share of nothing meets once a count
    instead of once a term; terms of both are then wrong by both corrections and are put right one by one, where the sparse
    postings of a term meet. No term by source table is made. Pairs of a language's sources are what is asked for, so only
    rows of them and of postings of one term, one a source, are joined to each other."""
    g, h = groups.alias("g"), groups.alias("h")
    pairs = g.join(h, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") < F.col("h.source")))
    neither = F.abs(F.col("g.zero") - F.col("h.zero"))
    base = pairs.select("g.lang", "g.source", F.col("h.source").alias("item"), F.coalesce(F.col("g.terms") * neither, F.lit(0)).alias("value"))
    counts = posts.groupBy("lang", "source", "n", "p", "zero").agg(F.count("*").alias("times")).alias("g")
    one = counts.join(h, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") != F.col("h.source")))
    value = F.col("times") * (F.abs(F.col("p") - F.col("h.zero")) - neither)
    one = one.select("g.lang", F.least("g.source", "h.source").alias("source"), F.greatest("g.source", "h.source").alias("item"), value.alias("value"))
    a, b = posts.alias("g"), posts.alias("h")
    both = a.join(b, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.term") == F.col("h.term")) & (F.col("g.source") < F.col("h.source")))
    value = F.abs(F.col("g.p") - F.col("h.p")) - F.abs(F.col("g.p") - F.col("h.zero")) - F.abs(F.col("h.p") - F.col("g.zero")) + neither
    both = both.select("g.lang", "g.source", F.col("h.source").alias("item"), value.alias("value"))
    total = None
    for part in (base, one, both):
        part = part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        total = part if total is None else total.unionByName(part)
    total = total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    way = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return total.select("lang", way.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def overused(posts: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value: the `top` terms of each group that it uses most beyond their share in its language. A group's
    terms are ranked in SALTS parts first, so that no task sorts all terms of a large one."""
    above = posts.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    ahead = F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "item"))
    above = above.withColumn("ahead", ahead).where(F.col("ahead") <= top)
    return ranked(above.select("lang", "source", "item", "value")).where(F.col("rank") <= top)


def ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source). Part `pair`: every other source of the language,
    the furthest first. Part `term`: the `top` terms that a source uses most beyond their share in its language.

    Null text, lang and source are empty strings; each row counts as a document, repeated rows too. A language whose terms are
    all too rare has distances of 0 and no terms; a group without kept terms has its share of nothing for each; an empty
    table gives no rows. All sums are whole numbers. Ties go to the item that is first by its bytes. Columns other than the
    three are not looked at. Per language, results grow with the square of its sources, which is what is asked for."""
    posts, groups = postings(docs, least)
    pair = ranked(distances(posts, groups)).withColumn("part", F.lit("pair"))
    term = overused(posts, top).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")
