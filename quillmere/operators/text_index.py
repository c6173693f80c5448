"""Keyword search: postings and BM25 over any (id, text) table."""

from __future__ import annotations

import math
import sys
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Tiers of a term's postings beyond the first, and how many times k rows the first ones read should hold.
LAST_TIER, FIRST = 20, 4
#: What stands between runs of ASCII letters and digits, and of letters and digits of any script.
ASCII, ANY = "[^a-z0-9]+", r"[^\p{L}\p{N}]+"


def plain_letters() -> dict[str, str]:
    """Each letter that is an ASCII letter under diacritics, with that letter: those that unicode61 strips."""
    forms = ((chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0x80, sys.maxunicode + 1))
    return {c: d[0] for c, d in forms if d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))}


PLAIN = plain_letters()


def fold(text):
    """Lower-cased text without diacritics: Latin letters lose theirs, marks that stand apart are dropped."""
    plain = F.lower(F.translate(text, "".join(PLAIN), "".join(PLAIN.values())))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.regexp_replace(plain, r"\p{Mn}", ""), "ς", "σ"))


def tokens(text, unicode: bool = False):
    """Lower-cased tokens: ASCII runs, or with unicode those of the folded text."""
    return F.array_remove(F.split(fold(text), ANY) if unicode else F.split(F.lower(text), ASCII), "")


def query_terms(text: str) -> list[str]:
    """The terms of a query, all of which are wanted: white-space words reduced to letters, their marks, digits and _."""
    kept = ("".join(c for c in word if c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") for word in text.split())
    return [w.lower() for w in kept if w]


def occurrences(parts):
    """How often the parts, a constant array of tokens, stand in _t one after another; no parts stand nowhere."""
    one = F.size("_t") - F.size(F.array_remove("_t", F.get(parts, F.lit(0))))
    run = F.size(F.filter("_t", lambda x, at: F.slice(F.col("_t"), at + 1, F.size(parts)) == parts))
    return F.when(F.size(parts) == 0, 0).when(F.size(parts) == 1, one).otherwise(run)


def bm25(table: DataFrame, id_col: str, text, query: str, all_terms: bool = True, unicode: bool = True) -> DataFrame:
    """id, score (lower is better) of the rows that hold all terms, or any. A term with _ is a phrase of its parts. Texts
    and terms are cut alike; without unicode, into ASCII runs.

    Terms are few, so nothing is exploded: each row counts its own, and the statistics are one aggregate over the scan."""
    terms = query_terms(query)
    if not terms:
        return table.select(id_col, F.lit(0.0).alias("score")).limit(0)
    # out of a generator, below which no filter is pushed: texts are cut once a pass
    counted = table.select(id_col, F.explode(F.array(tokens(text, unicode))).alias("_t")).withColumn("_dl", F.size("_t"))
    for i, term in enumerate(terms):
        counted = counted.withColumn(f"_f{i}", occurrences(tokens(F.lit(term), unicode)))
    counted = counted.drop("_t")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *frequencies(len(terms)))
    return scored(counted, stats, id_col, len(terms), all_terms)


def frequencies(terms: int) -> list:
    """How many rows hold each term."""
    return [F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(terms)]


def scored(counted: DataFrame, stats: DataFrame, id_col: str, terms: int, all_terms: bool) -> DataFrame:
    """id, score of the rows of counted (_dl, and _f of each term) that hold all terms, or any. stats is one row."""
    hits = [F.col(f"_f{i}") > 0 for i in range(terms)]
    wanted = hits[0]
    for h in hits[1:]:
        wanted = wanted & h if all_terms else wanted | h
    score = F.lit(0.0)
    for i in range(terms):
        n, f = F.col(f"_n{i}"), F.col(f"_f{i}")
        idf = F.log((F.col("_n") - n + 0.5) / (n + 0.5))
        score = score + F.when(idf <= 0, LEAST_IDF).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return counted.where(wanted).join(F.broadcast(stats)).select(id_col, (-score).alias("score"))  # stats: one row


def postings(table: DataFrame, id_col: str, text, unicode: bool = True) -> DataFrame:
    """term, id, at, dl, tier: each distinct token of a row with its places, and the row's number of tokens. Written in ranges of
    terms and their tiers (a frequent term fills several), so that a reader of few skips the other row groups."""
    placed = table.select(id_col, tokens(text, unicode).alias("_t")).select(id_col, F.size("_t").alias("dl"), F.posexplode("_t").alias("_at", "term"))
    found = placed.groupBy("term", id_col, "dl").agg(F.sort_array(F.collect_list("_at")).alias("at"))
    return found.select("term", id_col, "at", "dl", tier_of(F.col("at"), F.col("dl")))


def tier_of(at, dl):
    """How far down a term's postings a row stands: each tier has rows in which it is half as dense as in the one before."""
    return F.least(F.lit(LAST_TIER), F.floor(F.log2(dl / F.size(at)))).cast("int").alias("tier")


def in_ranges(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.repartitionByRange("term", "tier", id_col).sortWithinPartitions("term", "tier", id_col)


def most_of_tier(tier: int, avg: float) -> float:
    """No row of a tier or a later one gets more than this for a term, times its weight: f / dl is 1 / 2^tier at most, and the more
    often a term stands there, the nearer the row comes to it."""
    return (K1 + 1) / (1 + K1 * B * 2.0**tier / avg)


def tiers_needed(weights: list[float], avg: float, least: float) -> list[int]:
    """The last tier of each term in which a row with all terms could still reach a score of `least`; -1 if none could."""
    best = [w * most_of_tier(0, avg) for w in weights]
    return [max([t for t in range(LAST_TIER + 1) if w * most_of_tier(t, avg) + sum(best) - b >= least * (1 - 1e-12)], default=-1) for w, b in zip(weights, best)]


def bm25_top(stored: DataFrame, lengths: DataFrame, id_col: str, query: str, k: int) -> DataFrame:
    """The k best rows of bm25_of_postings() with all terms, ties to the smaller id, and perhaps others.

    Rows of the rarest term are intersected with the others', so that no frequent term's postings are gathered. First come those of its
    tiers that promise k rows; the kth score found tells how far down each term's tiers a better row could stand, and only these
    blocks are read again. Phrases go the whole way. What reaches the driver is a count for each term and tier, and a score."""
    terms = query_terms(query)
    parts = stored.sparkSession.sql("SELECT 1").select(F.array(*[tokens(F.lit(t), True) for t in terms])).first()[0] if terms else []
    if not any(parts) or any(len(run) != 1 for run in parts):
        return bm25_of_postings(stored, lengths, id_col, query)
    wanted = [run[0] for run in parts]
    counts: dict[str, dict[int, int]] = {}
    for r in stored.where(F.col("term").isin(sorted(set(wanted)))).groupBy("term", "tier").count().collect():
        counts.setdefault(r["term"], {})[r["tier"]] = r["count"]
    n, avg = lengths.select("_n", "_avg").first()
    if set(wanted) - counts.keys():
        return stored.select(id_col, F.lit(0.0).alias("score")).limit(0)
    order = sorted(wanted, key=lambda t: sum(counts[t].values()))
    df = [sum(counts[t].values()) for t in order]
    idf = [math.log((n - x + 0.5) / (x + 0.5)) for x in df]
    weights = [LEAST_IDF if x <= 0 else x for x in idf]

    def scores(last: list[int]) -> DataFrame:
        found = None
        for i, (term, tier) in enumerate(zip(order, last)):
            one = stored.where((F.col("term") == term) & (F.col("tier") <= tier)).select(id_col, F.col("dl").alias(f"_d{i}"), F.size("at").alias(f"_f{i}"))
            found = one if found is None else found.join(one, id_col)
        score = F.lit(0.0)
        for i, w in enumerate(weights):
            f = F.col(f"_f{i}")
            score = score + F.lit(w) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_d0") / F.lit(avg)))
        return found.select(id_col, (-score).alias("score"))

    seen, first = 0, LAST_TIER
    for tier in sorted(counts[order[0]]):
        seen += counts[order[0]][tier]
        if seen >= FIRST * k:
            first = tier
            break
    whole = [LAST_TIER] * len(order)
    if first == LAST_TIER:
        return scores(whole)
    some = scores([first, *whole[1:]]).orderBy("score", id_col).limit(k).agg(F.count("*").alias("n"), F.max("score").alias("kth")).first()
    return scores(tiers_needed(weights, avg, -some["kth"]) if some["n"] == k else whole)


def followed(starts, places, by: int):
    """The starts that have one of places `by` tokens later."""
    return F.filter(starts, lambda x: F.array_contains(places, x + F.lit(by)))


def bm25_of_postings(stored: DataFrame, lengths: DataFrame, id_col: str, query: str, all_terms: bool = True, unicode: bool = True) -> DataFrame:
    """bm25() from stored postings: reads those of the query's tokens alone, and no text. lengths is one row: _n, the number of
    rows, and _avg, their mean number of tokens."""
    terms = query_terms(query)
    cut = [tokens(F.lit(t), unicode) for t in terms]
    parts = stored.sparkSession.sql("SELECT 1").select(F.array(*cut)).first()[0] if terms else []
    if not any(parts):
        return stored.select(id_col, F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({p for run in parts for p in run})
    places = F.map_from_entries(F.collect_list(F.struct("term", "at")))
    counted = stored.where(F.col("term").isin(wanted)).groupBy(id_col).agg(F.first("dl").alias("_dl"), places.alias("_places"))
    for i, run in enumerate(parts):
        at = [F.coalesce(F.try_element_at("_places", F.lit(p)), F.array().cast("array<int>")) for p in run]
        starts = at[0] if run else F.array()
        for j, other in enumerate(at[1:], 1):
            starts = followed(starts, other, j)
        counted = counted.withColumn(f"_f{i}", F.size(starts))
    counted = counted.drop("_places")
    stats = counted.agg(*frequencies(len(parts))).join(F.broadcast(lengths))  # both one row
    return scored(counted, stats, id_col, len(parts), all_terms)


def top(hits: DataFrame, id_col: str, n: int, by: str = "score") -> DataFrame:
    return hits.orderBy(by, id_col).limit(n)
