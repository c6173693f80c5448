"""Spelling variant grouping: an errata trie over the corpus's words finds those one edit apart, which lead to root forms."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import UPPER, binary_texts, byte_list, discard, materialize, parts_for, recoded, slices, split_words

#: Code points and occurrences that a word needs, and how many times as frequent its form must be.
LETTERS, LEAST, TIMES = 6, 5, 5
#: Words of one task's part of the trie, about.
PART_WORDS = 1 << 17
#: Stands for the replaced character where two light subtrees meet; it is no letter.
ANY = "*"
# Bytes of runs: letters of ASCII, of which capitals become small ones, and C3 with what follows it (U+00C0 to U+00FF). All else is a space.
LETTER = np.array([b + 32 if chr(b) in UPPER else b if b < 128 and chr(b).isalpha() or b == 0xC3 else 32 for b in range(256)], np.uint8)
# Longest word in bytes whose hash is put together from tables.
TABLED = 64


def runs_only(data: np.ndarray) -> np.ndarray:
    after = np.r_[False, data[:-1] == 0xC3]
    return np.where(after, data, LETTER[data])


def shift_tables() -> np.ndarray:
    """[n, k, b]: byte k of a CRC-32 register of value b, carried over n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    now = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [now]
    for _ in range(TABLED):
        out.append(now := step[now & 255] ^ (now >> 8))
    return np.stack(out)


def joined_crc(tables: np.ndarray, heads: np.ndarray, tails: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-32 of a head and a tail one after the other, from their own and the tail's length (TABLED at most)."""
    out = tails.copy()
    for k in range(4):
        out ^= tables[lens, k, (heads >> np.uint32(8 * k)) & 255]
    return out


def word_counts(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, every: int | None = 199) -> DataFrame:
    """word, n: the words of docs (doc_id, text) with at least so many code points and occurrences. Words are runs of letters
    up to U+00FF, A-Z lower-cased. With `every`, a word whose crc32 of `doc_id:word` it divides loses one code point, the
    one at that hash modulo its length, wherever it stands in that document: misspellings planted by rule. A null
    doc_id is an empty one there. Slices of texts are counted before anything is shuffled."""

    def count(batches):
        tables = shift_tables()
        for batch in batches:
            for at, k in slices(batch.column("text")):
                codes, words, offsets = split_words(recoded(binary_texts(batch.column("text").slice(at, k)), runs_only), False)
                long = np.asarray(pc.greater_equal(pc.utf8_length(words), letters))
                each = max(1, len(words))
                of = np.repeat(np.arange(k), np.diff(offsets))
                held, n = np.unique((of * each + codes)[long[codes]] if len(codes) else np.zeros(0, np.int64), return_counts=True)
                doc, code = held // each, held % each
                values, changed = byte_list(words), []
                if every:
                    heads = [f"{'' if d is None else d}:".encode() for d in batch.column("doc_id").slice(at, k).to_pylist()]
                    lens = np.array([len(v) for v in values], np.int64)
                    h = joined_crc(tables, np.array([zlib.crc32(x) for x in heads], np.uint32)[doc], np.fromiter(map(zlib.crc32, values), np.uint32, len(values))[code], np.minimum(lens, TABLED)[code])
                    for i in np.flatnonzero(lens[code] > TABLED):
                        h[i] = zlib.crc32(heads[doc[i]] + values[code[i]])
                    hit = np.flatnonzero(h % np.uint32(every) == 0)
                    for i in hit:
                        w = values[code[i]].decode()
                        x = int(h[i]) % len(w)
                        if len(w) > letters:
                            changed.append((w[:x] + w[x + 1 :], int(n[i])))
                    n[hit] = 0
                total = np.bincount(code, n, each).astype(np.int64)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.take(pa.array(some)).cast(pa.string()), pa.array([w for w, _ in changed], pa.string())]), pa.array(np.r_[total[some], np.array([x for _, x in changed], np.int64)])], names=["word", "n"])

    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """The trie of sorted words by ranges of them: a node at depth d is the run of words that share d characters."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.lens = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.lens) - self.lens

    def levels(self):
        """By depth: (depth, words that still matter, their node, their child, per child: node, character (0: the word's end), size, first
        entry). A word is let go where it ends, or is alone below a node, unless it is the part's first or last word, whose
        nodes other parts may share."""
        alive, node, d, n = np.arange(len(self.words)), np.zeros(len(self.words), np.int64), 0, len(self.words)
        while len(alive):
            more = self.lens[alive] > d
            c = np.zeros(len(alive), np.uint32)
            c[more] = self.chars[self.at[alive[more]] + d]
            fresh = np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])]
            first = np.flatnonzero(fresh)
            child = np.cumsum(fresh) - 1
            size = np.diff(np.r_[first, len(alive)])
            yield d, alive, node, child, node[first], c[first], size, first
            shared = np.zeros(len(first), bool)
            shared[child[(alive == 0) | (alive == n - 1)]] = True
            keep = more & ((size > 1) | shared)[child]
            alive, node, d = alive[keep], child[keep], d + 1
            if len(node):
                node = np.cumsum(np.r_[0, node[1:] != node[:-1]])

    def shared(self, alive: np.ndarray, node: np.ndarray, d: int):
        """(node, its characters) of those that hold the part's first or last word."""
        found = {int(node[i]): self.words[alive[i]][:d] for i in (0, len(alive) - 1) if alive[i] in (0, len(self.words) - 1)}
        return found.items()


def shared_edges(table: pa.Table) -> pa.Table:
    """node, child, n, part: of a part's nodes that hold its first or last word, so that other parts may share them, how many of
    its words go on by each character, or end there (an empty one)."""
    words = sorted(table["word"].to_pylist())
    trie, rows = Trie(words), []
    for d, alive, node, _, of, c, size, _ in trie.levels():
        for i, name in trie.shared(alive, node, d):
            a, b = np.searchsorted(of, [i, i + 1])
            rows += [(name, chr(x) if x else "", int(k)) for x, k in zip(c[a:b], size[a:b])]
    part = table["part"][0].as_py() if len(table) else 0
    return pa.table({"node": pa.array([r[0] for r in rows], pa.string()), "child": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int64())})


def errata(table: pa.Table, heavy: pa.Table) -> pa.Table:
    """key, word, n: what a part's light subtrees hold once merged into their heavy sibling with one character skipped or
    replaced, and the other way round. heavy: node, child for nodes that other parts may share."""
    table = table.take(pc.sort_indices(table["word"].combine_chunks().cast(pa.binary())))
    words, n = table["word"].to_pylist(), np.asarray(table["n"], dtype=np.int64)
    trie, told = Trie(words), dict(zip(heavy["node"].to_pylist(), heavy["child"].to_pylist()))
    keys, of = [], []
    for d, alive, node, child, parent, c, size, first in trie.levels():
        best = np.zeros(int(parent[-1]) + 1, np.uint32)
        order = np.lexsort((c, -size, parent))
        order = order[c[order] > 0]
        top = np.r_[True, parent[order][1:] != parent[order][:-1]][: len(order)]
        best[parent[order[top]]] = c[order[top]]
        light_children = np.bincount(parent, c > 0, len(best)) - 1
        for i, name in trie.shared(alive, node, d):
            best[i] = ord(told[name]) if name in told else 0
            light_children[i] = 2
        h = best[node]
        light = np.flatnonzero((h > 0) & (c[child] != h))
        meets = (light_children >= 2)[node]
        for w, i, goes, by, wild in zip(map(words.__getitem__, alive[light]), alive[light].tolist(), (c[child[light]] > 0).tolist(), map(chr, h[light].tolist()), meets[light].tolist()):
            new = [w[:d] + by + w[d:]]
            if goes:
                new.append(w[:d] + by + w[d + 1 :])
                if w[d + 1 : d + 2] != w[d]:
                    new.append(w[:d] + w[d + 1 :])
                if wild:
                    new.append(w[:d] + ANY + w[d + 1 :])
            keys += new
            of += [i] * len(new)
    of = np.array(of, np.int64)
    return pa.table({"key": pa.array(keys, pa.string()), "word": table["word"].combine_chunks().take(pa.array(of)), "n": pa.array(n[of])})


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each two of words (word, n; no word twice, none with ANY) that differ by one inserted, deleted or
    replaced code point, once.

    Two such words part at one node of the trie of all words. At each node the child with most words is heavy. If one of the
    two goes on by a light child, or ends there, it meets the other as that merges into the heavy one: with its character there
    skipped, replaced by the heavy one, or the heavy one put before it. If both are light and differ by a replaced
    character, they meet under ANY. A word has at most log2 of all words light edges, so that many keys times four, and no more
    words meet under one key than there are letters.

    Words are dealt by ranges, so that a part holds all of each node below it but those of its first and last words; for these the parts'
    sums give the heavy child, joined by part. What is sent to one task is a part and its own shared nodes."""
    parts = parts_for(words.count(), PART_WORDS)
    dealt = materialize(words.select("word", "n").repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id().cast("long")), "words")
    edges = materialize(dealt.groupBy("part").applyInArrow(shared_edges, "node string, child string, n long, part long"), "edges")
    heavy = edges.where("child <> ''").groupBy("node", "child").agg(F.sum("n").alias("n")).groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("less"), "child")).alias("h")).select("node", "h.child")
    heavy = edges.select("node", "part").distinct().join(heavy, "node")
    found = dealt.groupBy("part").cogroup(heavy.groupBy("part")).applyInArrow(errata, "key string, word string, n long")
    found = materialize(found, "errata")
    wild = F.contains("key", F.lit(ANY))
    met = found.where(~wild).join(dealt.select(F.col("word").alias("b"), F.col("n").alias("b_n")), F.col("key") == F.col("b"))
    met = met.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n")
    group = found.where(wild).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("m")).where(F.size("m") > 1)
    group = group.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    return met.unionByName(group.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from each word of links (word, form; no word twice, no circle). Each
    round doubles how far a word has gone; frequencies grow along a way, so rounds are few."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        new = materialize(now.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new.select("word", "root")
        now._scratch = new._scratch
        if not new.where("moved").limit(1).count():
            return now


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of words (word, n): how many words are one edit away, the most frequent of them (ties: the
    first in code-point order) if it has `times` the word's occurrences or more, and the word that forms lead to."""
    words = materialize(words, "counts")
    pairs = near_pairs(words)
    one = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("x"))
    other = pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("x"))
    links = one.unionByName(other)
    near = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    near = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("x").getField("near").alias("near"), (-F.col("x").getField("less")).alias("near_n"))
    fits = F.col("near_n") >= times * F.col("n")
    near = materialize(near.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "near")
    ends = roots(near.where(F.col("form").isNotNull()).select("word", "form"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, every: int | None = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs (doc_id, text); see word_counts() and grouped().

    Null and empty texts have no words; each row counts, repeated rows and doc_ids too; an empty table gives no rows. Words
    of any length are handled whole. Columns other than the two are not looked at."""
    return grouped(word_counts(docs, every=every)).select("word", "form", "root", "n", "n_near", "form_n")
