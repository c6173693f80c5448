"""Token ids as binary shards: texts are encoded, and each block's ids are compressed by a Re-Pair grammar."""

from __future__ import annotations

import itertools
import json
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.common import binary_texts, byte_list, scratch_path, shuffle_partitions, slices, split_words

#: Bytes of text of a block, one document at least.
BLOCK_BYTES = 4 << 20
#: Pairs replaced in a round, and occurrences that a pair needs.
PER_ROUND, LEAST = 4096, 4
#: Distinct words whose ids a worker remembers, and words that are encoded in one text.
REMEMBERED, TOGETHER = 1_000_000, 200
PLAIN = ".,!?;:"
# The normaliser, pre-tokenizer and word end of the files whose words can be encoded one by one.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
WORD_END = "</w>"
# The printable character that stands for each byte in vocabularies over bytes: itself where it is one, else the next free one from 256 on.
KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = [chr(b if b in KEPT else 256 + sum(x not in KEPT for x in range(b))) for b in range(256)]
MAGIC = b"QMRP"
HEAD = "<4sIIIIQ"


class Encoder:
    """Ids of texts by a tokenizers file. Where its normaliser and pre-tokenizer are BY_WORD, which never join over white space,
    every distinct word between ASCII white space is encoded once and remembered; by any other file texts are encoded whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        added = says.get("added_tokens") or []
        plain = not any(c.isspace() for t in added for c in t["content"])
        self.by_word = plain and says["model"].get("end_of_word_suffix") == WORD_END and all(says.get(k) == v for k, v in BY_WORD.items())
        marks = [t for t in added if t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])]
        self.mark = (marks[0]["content"].encode(), marks[0]["id"]) if marks else None
        self.forget()

    def forget(self) -> None:
        """place numbers the words known; flat has their ids one after the other, lens how many each has."""
        self.place, self.flat, self.lens = {b"": 0}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Words are encoded many in one text, parted by an added token: the library takes it out of the raw text first, so
        that each word between two is encoded by itself. A word that holds its name, or has no such token, is encoded alone.
        One of small letters that NFC leaves as it is, normaliser and pre-tokenizer leave too, so the model gets it at once."""
        mark, mark_id = self.mark or (b"", -1)
        texts = [w.decode() for w in words]
        small = [t.isalpha() and t.islower() and (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in texts]
        letters = list(itertools.compress(words, small))
        words = [w for w, s in zip(words, small) if not s]
        joined = [w for w in words if mark and mark not in w]
        alone = [w for w in words if not mark or mark in w]
        model = self.tokenizer.model
        pieces = [[t.id for t in model.tokenize(w.decode() if w.isascii() else "".join([BYTES[b] for b in w]))] for w in letters]
        parts = [joined[at : at + TOGETHER] for at in range(0, len(joined), TOGETHER)]
        flat = [self.flat, np.fromiter(itertools.chain.from_iterable(pieces), np.uint32)]
        lens = [self.lens, np.fromiter(map(len, pieces), np.int64, len(pieces))]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([mark.join(p).decode() for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == mark_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("the added token doesn't part words")
            flat.append(ids[ids != mark_id])
            lens.append(np.diff(np.r_[-1, cuts, len(ids)]) - 1)
        for e in self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False):
            flat.append(np.array(e.ids, np.uint32))
            lens.append(np.array([len(e.ids)]))
        self.place.update(zip(letters + joined + alone, itertools.count(len(self.lens))))
        self.flat, self.lens = np.concatenate(flat), np.concatenate(lens)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has. A word of letters followed by plain punctuation has the ids
        of both, as the pre-tokenizer cuts there; a word of letters has the same ids in either case, as the normaliser lowers it.
        Letters that NFC would change may turn into letters and marks, and are encoded with what follows them."""
        if len(self.place) > REMEMBERED:
            self.forget()
        core = pc.utf8_rtrim(words, characters=PLAIN)
        alpha = pc.utf8_is_alpha(core)
        other = np.flatnonzero(np.asarray(pc.and_(alpha, pc.invert(pc.string_is_ascii(core)))))
        if len(other):
            some, letters = core.take(pa.array(other)), np.asarray(alpha).copy()
            letters[other] = np.asarray(pc.equal(pc.utf8_normalize(some, form="NFC"), some))
            alpha = pa.array(letters)
        coded = pc.if_else(alpha, pc.ascii_lower(core), words).dictionary_encode()
        heads = byte_list(coded.dictionary)
        cut = np.where(np.asarray(alpha), np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(core)), 0)
        at = np.flatnonzero(cut)
        tails = [w[-n:] for w, n in zip(byte_list(words.take(pa.array(at))), cut[at].tolist())]
        place = self.place
        found = list(map(place.get, heads))
        new = [i for i, x in enumerate(found) if x is None]
        self.learn(list(dict.fromkeys([*(heads[i] for i in new), *(t for t in set(tails) if t not in place)])))
        for i in new:
            found[i] = place[heads[i]]
        head = np.array(found, np.int64)[np.asarray(coded.indices)]
        tail = np.zeros(len(words), np.int64)
        tail[at] = [place[t] for t in tails]
        return gathered(self.flat, self.lens, np.stack([head, tail], 1).ravel()), self.lens[head] + self.lens[tail]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, `end` after each, and where each text's ids end."""
        if not self.by_word:
            found = [[*e.ids, end] for e in self.tokenizer.encode_batch_fast(binary_texts(texts).to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum([len(ids) for ids in found], dtype=np.int64)
        codes, words, offsets = split_words(binary_texts(texts), False)
        flat, lens = self.word_ids(words)
        codes = np.insert(codes.astype(np.int64), offsets[1:], len(lens))
        flat, lens = np.r_[flat, np.uint32(end)], np.r_[lens, 1]
        return gathered(flat, lens, codes), np.cumsum(lens[codes])[offsets[1:] + np.arange(len(texts))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gathered(flat: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pieces of flat that the codes name, one after the other; piece i has lens[i] entries."""
    at, n = np.r_[0, np.cumsum(lens)[:-1]] if len(lens) else lens, lens[codes]
    return flat[np.repeat(at[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def grammar(ids: np.ndarray, ends: np.ndarray, per_round: int = PER_ROUND, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (first nonterminal, rules as pairs, symbols, where each document's symbols end).

    Each round counts all neighbouring pairs inside documents and gives the most frequent ones nonterminals; occurrences
    that overlap are taken from the left. Departures from one pair at a time down to two occurrences: a round replaces up to
    `per_round` pairs, and it ends when no pair occurs `least` times (a rule of two symbols and a length costs more than
    three occurrences save), or when 16-bit symbols run out (for ids that need more, 32-bit ones)."""
    base = int(ids.max(initial=0)) + 1
    bits = 16 if base < 1 << 16 else 31
    room, kind = (1 << bits) - base, np.uint32 if bits == 16 else np.uint64
    seq = ids.astype(kind)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    top = base
    while room > 0 and len(seq) > 1:
        inside = ~last[:-1]
        pairs = (seq[:-1] << kind(bits)) | seq[1:]
        counted, n = np.unique(pairs[inside], return_counts=True)
        frequent = np.flatnonzero(n >= least)
        if not len(frequent):
            break
        take = min(per_round, room)
        if len(frequent) > take:
            frequent = frequent[np.argsort(-n[frequent], kind="stable")[:take]]
        chosen = np.sort(counted[frequent])
        left, right = (chosen >> kind(bits)).astype(np.int64), (chosen & kind((1 << bits) - 1)).astype(np.int64)
        firsts, seconds = np.unique(left), np.unique(right)
        # Places in a table of chosen pairs by the rank of their first and of their second symbol; rank 0 is all others.
        row, col = np.zeros(top, np.int32), np.zeros(top, np.int32)
        row[firsts], col[seconds] = np.arange(1, len(firsts) + 1) * (len(seconds) + 1), np.arange(1, len(seconds) + 1)
        named = np.zeros((len(firsts) + 1) * (len(seconds) + 1), np.int32)
        named[row[left] + col[right]] = np.arange(1, len(chosen) + 1)
        which = named[row[seq[:-1]] + col[seq[1:]]]
        at = np.flatnonzero(inside & (which > 0))
        which = which[at] - 1
        fresh = np.r_[True, np.diff(at) != 1]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        whole = (np.arange(len(at)) - run) % 2 == 0
        at, which = at[whole], which[whole]
        used, which = np.unique(which, return_inverse=True)
        seq[at] = top + which
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([left[used], right[used]], 1))
        top, room = top + len(used), room - len(used)
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), seq, np.flatnonzero(last) + 1


def expansions(base: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol that occurs in rules or text stands for: ids one after the other, and lengths."""
    parts = list(np.arange(base, dtype=np.uint32).view("V4").tolist())
    for a, b in rules.tolist():
        parts.append(parts[a] + parts[b])
    return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def packed(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The block: header (width, rules, symbols, documents, first nonterminal | ids), the rules' pairs and expansion
    lengths, the symbols, and per document where its symbols and its ids end."""
    base, rules, seq, symbol_ends = grammar(ids, ends)
    lens = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lens[base + i] = lens[a] + lens[b]
    kind = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
    head = struct.pack(HEAD, MAGIC, np.dtype(kind).itemsize, len(rules), len(ends), base, len(seq))
    return b"".join([head, rules.astype(kind).tobytes(), lens[base:].astype(np.uint32).tobytes(), seq.astype(kind).tobytes(), symbol_ends.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes()])


class Block:
    """Reads a block; ids(i) decodes one document, ids() all, span(start, stop) any stretch of the block's ids."""

    def __init__(self, data: bytes) -> None:
        magic, width, n_rules, n_docs, self.base, n = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at, kind = struct.calcsize(HEAD), np.uint16 if width == 2 else np.uint32

        def read(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        self.rules = read(kind, 2 * n_rules).reshape(-1, 2)
        self.lens = np.r_[np.ones(self.base, np.int64), read(np.uint32, n_rules)]
        self.symbols = read(kind, n)
        self.symbol_ends, self.ends = read(np.int64, n_docs), read(np.int64, n_docs)
        self._flat: np.ndarray | None = None

    def decoded(self, symbols: np.ndarray) -> np.ndarray:
        if self._flat is None:
            self._flat, _ = expansions(self.base, self.rules)
        return gathered(self._flat, self.lens, symbols.astype(np.int64))

    def ids(self, doc: int | None = None) -> np.ndarray:
        if doc is None:
            return self.decoded(self.symbols)
        return self.decoded(self.symbols[self.symbol_ends[doc - 1] if doc else 0 : self.symbol_ends[doc]])

    def span(self, start: int, stop: int) -> np.ndarray:
        """Only the symbols that cover the stretch are expanded."""
        ends = np.cumsum(self.lens[self.symbols])
        first, after = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (ends[first - 1] if first else 0)
        return self.decoded(self.symbols[first:after])[skip : skip + stop - start]


SHARDS = T.StructType([T.StructField("shard", T.LongType()), T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_ids", T.LongType()), T.StructField("payload", T.BinaryType())])


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 2) -> None:
    """Writes docs (doc_id, text) in ascending doc_id order (null first; ties by a hash of the text): shard and block
    number the rows of the Parquet files under folder, each of which carries one block. Spark's writer commits a task's
    files whole, so a lost executor leaves none behind. Null texts are empty: their `end` id alone. A block is the shard of
    one grammar, about BLOCK_BYTES of text and one document at least. doc_id must be a whole number, or a string of one."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def encode(batches):
        from pyspark import TaskContext

        shard, block, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            for at, k in slices(texts, BLOCK_BYTES):
                ids, ends = enc.encode(texts.slice(at, k), end)
                doc_ids = batch.column("doc_id").slice(at, k).cast(pa.int64()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([packed(ids, ends)], pa.binary())], names=SHARDS.names)
                block += 1

    rows.mapInArrow(encode, SHARDS).write.option("compression", "zstd").parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under folder. Starts are sums over shards (one
    row each) and over a shard's blocks."""
    files = spark.read.schema(SHARDS).parquet(folder)
    sums = files.select("shard", "block", "n_ids")
    shards = sums.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    below = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("block_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(shards, "shard")
    starts = starts.select(F.col("shard").alias("s"), F.col("block").alias("b"), (F.col("shard_start") + F.col("block_start")).alias("block_start"))

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column("payload")[row].as_py())
                ids, stops = block.ids().astype("<u4"), block.ends
                begins = np.r_[0, stops[:-1]]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, stops)]
                k = len(stops)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, batch.column(c)[row].as_py()), pa.int64()) for c in ("shard", "block")] + [batch.column("doc_ids").slice(row, 1).flatten(), pa.array(begins, pa.int64()), pa.array(stops - begins, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    out = files.select("shard", "block", "doc_ids", "payload").mapInArrow(decode, "shard long, block long, doc_id long, at long, n_tokens long, ids_crc32 long")
    out = out.join(starts, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    return out.select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str, end: int = 2, folder: str | None = None) -> DataFrame:
    """Writes docs and reads the files back; see write() and read(). An empty table gives no rows."""
    folder = folder or scratch_path(docs.sparkSession, "shards")
    write(docs, folder, tokenizer, end)
    return read(docs.sparkSession, folder)
