"""Packing by powers of two: each document's ids are cut into pieces of binary lengths, and pieces of one length form a bucket."""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.common import binary_texts, byte_list, scratch_path, slices
from quillmere.llm.repair import gathered

#: Longest sequence, the id that ends a document, and bytes of text that are encoded together.
LONGEST, END, BLOCK_BYTES = 1024, 0, 4 << 20
#: Distinct stretches whose ids a worker remembers, and stretches that are encoded in one text.
REMEMBERED, TOGETHER = 1_000_000, 200
# The pre-tokenizer of the files whose texts may be cut before white space.
BY_STRETCH = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
SPACES, PLAIN = b"\t\n\x0b\x0c\r ", b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
IS_SPACE, IS_PLAIN, IS_WORD, IS_CONTROL = (np.isin(np.arange(256), list(x)) for x in (SPACES, PLAIN, [b for b in range(128) if chr(b).isalnum()], [*range(9), *range(14, 32), 127]))


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where UTF-8 texts, one after the other, may be cut so that each stretch has the ids it has in the whole text: at
    each text's start, before each run of ASCII white space, and between an ASCII letter or digit and plain punctuation.
    There the pre-tokenizer ends a piece whatever follows (apostrophes begin endings, and <|> stand in added tokens). Where other white space, control or format characters
    stand before the run, which its patterns may take together, nothing is cut."""
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    before = np.r_[np.uint8(0), data[:-1]]
    space = IS_SPACE[data]
    cut = (space & ~np.r_[False, space[:-1]]) | (IS_PLAIN[data] & IS_WORD[before])
    at = np.flatnonzero(cut & ~first[:-1])
    b1, b2, b3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    joint = IS_CONTROL[b1] | ((b2 == 0xC2) & (b1 <= 0xA0)) | ((b3 == 0xE1) & np.isin(b2, (0x9A, 0xA0))) | ((b3 == 0xE2) & (b2 == 0x80) & (b1 <= 0x8F)) | ((b3 == 0xE2) & (b2 == 0x80) & np.isin(b1, (0xA8, 0xA9, 0xAF))) | ((b3 == 0xE2) & (b2 == 0x81)) | ((b3 == 0xE3) & (b2 == 0x80)) | ((b3 == 0xEF) & (b2 == 0xBB))
    first[at[~(joint & space[at])]] = True
    return np.flatnonzero(first[:-1])


class Encoder:
    """Ids of texts by a tokenizers file. Where it has the pre-tokenizer BY_STRETCH, every distinct stretch between cut points
    is encoded once and remembered; by any other file texts are encoded whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        added = says.get("added_tokens") or []
        apart = [t for t in added if not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and t["content"].isascii() and not set(t["content"].encode()) & {*SPACES, *PLAIN}]
        marks = [t for t in apart if t["special"]]
        self.by_stretch = bool(marks) and len(apart) == len(added) and says["model"]["type"] == "BPE" and all(says.get(k) == v for k, v in BY_STRETCH.items())
        self.mark, self.mark_id = (marks[0]["content"].encode(), marks[0]["id"]) if marks else (b"", -1)
        self.forget()

    def forget(self) -> None:
        """place numbers the stretches known; flat has their ids one after the other, lens how many each has."""
        self.place, self.flat, self.lens = {}, np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Stretches are encoded many in one text, parted by an added token, which the library takes out of raw text first."""
        joined, alone = [x for x in new if self.mark not in x], [x for x in new if self.mark in x]
        parts = [joined[at : at + TOGETHER] for at in range(0, len(joined), TOGETHER)] + [[x] for x in alone]
        flat, lens = [self.flat], [self.lens]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.mark.join(p).decode() for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id) if len(part) > 1 else np.zeros(0, np.int64)
            if len(cuts) != len(part) - 1:
                raise ValueError("the added token doesn't part stretches")
            flat.append(np.delete(ids, cuts))
            lens.append(np.diff(np.r_[-1, cuts, len(ids)]) - 1)
        self.place.update(zip(joined + alone, itertools.count(len(self.lens))))
        self.flat, self.lens = np.concatenate(flat), np.concatenate(lens)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, `end` after each, and where each text's ids end. Null texts are empty."""
        texts = binary_texts(texts)
        if not self.by_stretch:
            found = [[*e.ids, end] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array(list(itertools.chain.from_iterable(found)), np.uint32), np.cumsum([len(ids) for ids in found], dtype=np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        cuts = cut_points(data, offsets[:-1][np.diff(offsets) > 0])
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.r_[cuts, len(data)].astype(np.int64)), pa.py_buffer(data)])
        coded = stretches.dictionary_encode()
        if len(self.place) > REMEMBERED:
            self.forget()
        values = byte_list(coded.dictionary)
        self.learn([x for x in values if x not in self.place])
        codes = np.fromiter(map(self.place.__getitem__, values), np.int64, len(values))[np.asarray(coded.indices, dtype=np.int64)]
        last = np.searchsorted(cuts, offsets[1:], "left")  # stretches that begin before the text's end
        codes = np.insert(codes, last, len(self.lens))
        flat, lens = np.r_[self.flat, np.uint32(end)], np.r_[self.lens, 1]
        return gathered(flat, lens, codes), np.cumsum(lens[codes])[last + np.arange(len(texts))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(lens: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these lengths: as many of the longest, a power of two, as
    fit, then one for each binary digit of the rest, the highest first."""
    whole, rest = lens // longest, lens % longest
    of, start, length = [np.repeat(np.arange(len(lens)), whole)], [], []
    start.append((np.arange(len(of[0])) - np.repeat(np.cumsum(whole) - whole, whole)) * longest)
    length.append(np.full(len(of[0]), longest))
    at = whole * longest
    for bit in reversed(range(longest.bit_length() - 1)):
        some = np.flatnonzero(rest & (1 << bit))
        of.append(some)
        start.append(at[some])
        length.append(np.full(len(some), 1 << bit))
        at[some] += 1 << bit
    return np.concatenate(of), np.concatenate(start), np.concatenate(length)


def bucket_schema(doc_id: T.DataType) -> T.StructType:
    many = T.ArrayType(T.LongType())
    kinds = {"length": T.LongType(), "first": T.LongType(), "doc_ids": T.ArrayType(doc_id), "starts": many, "doc_tokens": many, "width": T.LongType(), "payload": T.BinaryType()}
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, longest: int = LONGEST) -> None:
    """Writes the sequences of docs (doc_id, text) to Parquet files under folder. A row is a bucket of pieces of one length
    from one block of texts: the number of its first sequence, doc_ids, starts and doc_tokens of its pieces, and their ids as
    a matrix of `width` bytes each. A piece is a sequence, so none crosses documents and, as each has a power of two of ids,
    none is padded. Sequences are numbered by task and place in the task, which Spark's writer commits whole. Texts are
    encoded where they lie; nothing is shuffled."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    kind = bucket_schema(docs.schema["doc_id"].dataType)

    def pack(batches):
        from pyspark import TaskContext

        number, enc = TaskContext.get().partitionId() << 40, encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
        for batch in batches:
            for at, k in slices(batch.column("text"), BLOCK_BYTES):
                ids, ends = enc.encode(batch.column("text").slice(at, k), end)
                begins = np.r_[0, ends[:-1]]
                doc_ids, lens = batch.column("doc_id").slice(at, k), ends - begins
                of, start, length = pieces(lens, longest)
                rows = []
                for n in np.unique(length).tolist():
                    some = np.flatnonzero(length == n)
                    matrix = ids[(begins[of[some]] + start[some])[:, None] + np.arange(n)]
                    rows.append((n, number, doc_ids.take(pa.array(of[some])), start[some], lens[of[some]], width, matrix.astype(f"<u{width}").tobytes()))
                    number += len(some)
                held = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r[c]) for r in rows])], pa.int32()), pa.concat_arrays([r[2] for r in rows]) if c == 2 else pa.array(np.concatenate([r[c] for r in rows]), pa.int64())) for c in (2, 3, 4)]
                one = lambda c: pa.array([r[c] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([one(0), one(1), *held, one(5), pa.array([r[6] for r in rows], pa.binary())], names=kind.names)

    docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pack, kind).write.option("compression", "zstd").parquet(folder)


def sequences(spark, folder: str, doc_id: T.DataType | None = None, length: int | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids of the sequences under folder, of one length if asked for,
    where Parquet skips all others' ids. ids: little-endian unsigned 32-bit integers. offset is 0, as a piece is a sequence."""
    kind = bucket_schema(doc_id or T.LongType())
    files = spark.read.schema(kind).parquet(folder)
    if length is not None:
        files = files.where(F.col("length") == length)

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, first, width = (batch.column(c)[row].as_py() for c in ("length", "first", "width"))
                ids = np.frombuffer(batch.column("payload")[row].as_py(), f"<u{width}").astype("<u4")
                k = len(ids) // n
                ids = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((np.arange(k + 1) * (4 * n)).astype(np.int32)), pa.py_buffer(ids)])
                lists = [batch.column(c).slice(row, 1).flatten() for c in ("doc_ids", "starts", "doc_tokens")]
                each = [pa.array(x, pa.int64()) for x in (np.full(k, n), np.arange(first, first + k), np.zeros(k, np.int64))]
                yield pa.RecordBatch.from_arrays([lists[0], lists[1], each[0], lists[2], each[1], each[2], ids], names=out.names)

    out = T.StructType([T.StructField("doc_id", doc_id or T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])
    return files.mapInArrow(unpack, out)


def packed(docs: DataFrame, tokenizer: str, end: int = END, longest: int = LONGEST, folder: str | None = None) -> DataFrame:
    """Writes the sequences of docs and reads them back; see write() and sequences().

    Null and empty texts are a document of its end id alone, one sequence of length 1. Repeated rows and doc_ids are documents
    each; a null doc_id stays null; doc_id keeps its type. A very long text is encoded in one task, whole. An empty table
    gives no rows. Columns other than the two are not looked at."""
    folder = folder or scratch_path(docs.sparkSession, "sequences")
    write(docs, folder, tokenizer, end, longest)
    return sequences(docs.sparkSession, folder, docs.schema["doc_id"].dataType)
