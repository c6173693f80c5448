"""Substring dedup by a log-structured index of window fingerprints, verified window by window."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.common import M1, M2, binary_texts, byte_list, discard, grams, hashes, materialize, pack_sorted, parts_of, scratch_root, split_words, unpack_sorted

#: Words of a shingle within a window; a window's fingerprint is the least hash of its shingles.
SHINGLE = 5
#: Bytes of text of a chunk, one doc_id at least, and the runs that an index may hold before they are compacted.
CHUNK_BYTES, RUNS = 8 << 20, 2
#: Bytes of text of a part: a range of doc_id that a task cuts into chunks. There are as many ranges of hashes as parts.
PART_BYTES = 64 << 20
SHARED = -1
#: Bits of a chunk's number: calls of an index before it, parts, chunks of a part.
CALL, PART = 44, 20
U = np.uint64
FIELDS = {"part": T.LongType(), "chunk": T.LongType(), "bucket": T.LongType(), "keys": T.BinaryType(), "owners": T.BinaryType(), "payload": T.BinaryType()}


def schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, FIELDS[n]) for n in names])


def batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[FIELDS[n]]) for i, n in enumerate(names)], names=list(names))


def sealed(ids: pa.Array, texts: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": ids, "text": texts})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Chunk:
    """Documents in order of doc_id (null first): their words as codes, and the hashes of their windows."""

    def __init__(self, payload: bytes, window: int) -> None:
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.ids = table["doc_id"].combine_chunks()
        self.codes, words, self.offsets = split_words(binary_texts(table["text"].combine_chunks()), False)
        self.words = byte_list(words)
        self.window = window
        order = np.asarray(self.ids.fill_null(np.iinfo(np.int64).min))
        doc = np.repeat(np.arange(len(order)), np.diff(self.offsets))
        self.h = hashes(words)[self.codes] if len(self.codes) else np.zeros(0, U)
        n = max(0, len(doc) - window + 1)
        self.starts = np.flatnonzero(doc[:n] == doc[window - 1 :][:n])
        self.doc, self.order = doc[self.starts], order[doc[self.starts]]
        self.first = grams(self.h, window, M1)[self.starts] if n else np.zeros(0, U)

    def check(self) -> np.ndarray:
        return (grams(self.h, self.window, M2)[self.starts] >> U(32)).astype(np.uint32) if len(self.starts) else np.zeros(0, np.uint32)

    def fingerprints(self) -> np.ndarray:
        """Each window's: the same words give the same, so windows that are equal meet under one fingerprint."""
        if not len(self.starts):
            return np.zeros(0, U)
        g = grams(self.h, SHINGLE)
        wide, out = self.window - SHINGLE + 1, np.empty(len(self.starts), U)
        views = sliding_window_view(g, wide)
        for at in range(0, len(out), 1 << 18):
            out[at : at + (1 << 18)] = views[self.starts[at : at + (1 << 18)]].min(1)
        return out

    def shared_here(self, key: np.ndarray) -> np.ndarray:
        """The distinct keys of windows, and which of them occur under several doc_ids of this chunk."""
        order = np.argsort(key, kind="stable")
        k, o = key[order], self.order[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at) if len(k) else np.zeros(0, bool)
        return k[at], many

    def repeats(self, told_first: np.ndarray, told_check: np.ndarray) -> np.ndarray:
        """Windows whose words also start in a document with a smaller doc_id: told ones, of earlier chunks, and those here."""
        check = self.check()
        out = np.zeros(len(self.starts), bool)
        if len(told_first):
            order = np.lexsort((told_check, told_first))
            a, b = told_first[order], told_check[order]
            at = np.searchsorted(a, self.first)
            while True:  # windows of equal first hash stand next to each other
                within = np.minimum(at, len(a) - 1)
                same = (at < len(a)) & (a[within] == self.first)
                out |= same & (b[within] == check)
                if not (on := same & ~out).any():
                    break
                at = at + on
                at[~on] = len(a)
        order = np.lexsort((np.arange(len(check)), check, self.first))
        f, c, o = self.first[order], check[order], self.order[order]
        if len(f):
            at = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (c[1:] != c[:-1])])
            least = np.repeat(np.minimum.reduceat(o, at), np.diff(np.r_[at, len(f)]))
            out[order[o > least]] = True
        return out

    def removed(self, repeats: np.ndarray) -> np.ndarray:
        """Words covered by those windows."""
        edge = np.zeros(len(self.codes) + 1, np.int64)
        at = self.starts[repeats]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def chunked(docs: DataFrame, window: int, n: int, call: int) -> tuple[DataFrame, str]:
    """part, chunk, payload: docs in n ranges of doc_id, as a table (and its name) bucketed by part, so that what is told to a part
    finds it without another shuffle. Chunks ascend with doc_id; rows of one doc_id are never parted."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def cut(batches):
        from pyspark import TaskContext

        part, seq, held, size = call << CALL - PART | TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            ids, texts = b.column("doc_id").cast(pa.int64()), binary_texts(b.column("text"))
            sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
            plain = ids.to_pylist()
            at = 0
            for i in range(len(plain)):
                last = (held[-1][0][-1].as_py() if held else None) if i == 0 else plain[i - 1]
                if size + int(sizes[at:i].sum() if i > at else 0) >= CHUNK_BYTES and (held or i > at) and plain[i] != last:
                    if i > at:
                        held.append((ids.slice(at, i - at), texts.slice(at, i - at)))
                    yield batch([(part, part << PART | seq, sealed(*(pa.concat_arrays([h[j] for h in held]) for j in (0, 1))))], "part", "chunk", "payload")
                    held, size, at, seq = [], 0, i, seq + 1
            if at < len(plain):
                held.append((ids.slice(at), texts.slice(at)))
                size += int(sizes[at:].sum())
        if held:
            yield batch([(part, part << PART | seq, sealed(*(pa.concat_arrays([h[j] for h in held]) for j in (0, 1))))], "part", "chunk", "payload")

    name = f"quillmere_chunks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(cut, schema("part", "chunk", "payload"))
    made.write.format("parquet").bucketBy(n, "part").option("path", f"{scratch_root(spark)}/quillmere/{name}").saveAsTable(name)
    return spark.table(name), name


def bucketed(keys: np.ndarray, buckets: int):
    """(bucket, from, to) of the parts of sorted keys: ranges of equal width."""
    of = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for i, j in zip(at, [*at[1:], len(of)]):
        yield int(of[i]), i, j


def there(spark, path: str) -> bool:
    """Whether Spark's own file system has the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, each with its only chunk or the mark SHARED. A batch is merged with them:
    what is in a run or in two of its chunks is shared, and the chunks that hold it are told. The batch then becomes a
    run; more than RUNS runs are compacted into one. Runs are Parquet in the shared folder, a row per range of hashes.

    With a folder the index outlives a call: save() writes its compacted run, the hashes of all windows under shared
    fingerprints and the call's chunks to a folder of the call's number, and a mark last, without which open() ignores them."""

    def __init__(self, buckets: int, window: int, folder: str | None = None) -> None:
        self.buckets, self.window, self.folder, self.call, self.runs = buckets, window, folder, 0, []
        self.windows: DataFrame | None = None
        self.old: list[DataFrame] = []
        self.scratch: list[DataFrame] = []

    @classmethod
    def open(cls, spark, folder: str, buckets: int, window: int = 13) -> FingerprintIndex:
        """The index saved under folder; where there is none, an empty one of `buckets` ranges of hashes."""
        index = cls(buckets, window, folder)
        while there(spark, f"{folder}/{index.call}/saved/_SUCCESS"):
            index.old.append(spark.read.parquet(f"{folder}/{index.call}/chunks"))
            index.call += 1
        if index.call:
            at = f"{folder}/{index.call - 1}"
            index.buckets, saved = (spark.read.parquet(f"{at}/saved").first()[c] for c in ("buckets", "window"))
            if saved != window:
                raise ValueError(f"the index under {folder} has windows of {saved} words")
            index.runs, index.windows = [spark.read.parquet(f"{at}/run")], spark.read.parquet(f"{at}/windows")
        return index

    def save(self, chunks: DataFrame, windows: DataFrame) -> None:
        at, put = f"{self.folder}/{self.call}", lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{self.call}/{name}")
        self.compact()
        put(self.runs[0], "run")
        put(windows, "windows")
        put(chunks.select("part", "chunk", "payload"), "chunks")
        put(chunks.sparkSession.createDataFrame([(self.buckets, self.window)], "buckets long, window long"), "saved")
        spark = chunks.sparkSession
        self.runs, self.windows = [spark.read.parquet(f"{at}/run")], spark.read.parquet(f"{at}/windows")
        self.old.append(spark.read.parquet(f"{at}/chunks"))
        self.call += 1

    def add(self, chunks: DataFrame) -> DataFrame:
        """part, chunk, keys: fingerprints, sorted, that this batch has made shared, for every chunk that holds them."""
        window, buckets = self.window, self.buckets

        def mark(batches):
            for b in batches:
                for part, chunk, payload in zip(*[b.column(c).to_pylist() for c in ("part", "chunk", "payload")]):
                    keys = np.unique(Chunk(payload, window).fingerprints())
                    if rows := [(of, chunk, pack_sorted(keys[i:j]), None) for of, i, j in bucketed(keys, buckets)]:
                        yield batch(rows, "bucket", "chunk", "keys", "owners")

        def merge(table):
            key, owner, old = [], [], []
            for chunk, k, o in zip(*[table[c].to_pylist() for c in ("chunk", "keys", "owners")]):
                k = unpack_sorted(k)
                key.append(k)
                owner.append(np.frombuffer(o, np.int64) if o is not None else np.full(len(k), chunk))
                old.append(np.full(len(k), o is not None))
            key, owner, old = map(np.concatenate, (key, owner, old))
            order = np.argsort(key, kind="stable")
            key, owner, old = key[order], owner[order], old[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.diff(np.r_[at, len(key)])
            fresh = np.add.reduceat((~old).astype(np.int64), at)
            known = np.minimum.reduceat(np.where(old, owner, np.iinfo(np.int64).max), at)  # SHARED is least
            live = (fresh > 0) & (n > 1)
            tell = np.repeat(live, n) & (~old | ((owner != SHARED) & np.repeat(known != SHARED, n)))
            bucket, out = table["bucket"][0].as_py(), []
            held = np.argsort(owner[tell], kind="stable")
            who, what = owner[tell][held], key[tell][held]
            cuts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else []
            for i, j in zip(cuts, [*cuts[1:], len(who)]):
                out.append((int(who[i]) >> PART, int(who[i]), bucket, pack_sorted(what[i:j]), None))
            new = (fresh > 0) & (known != SHARED)
            if new.any():
                out.append((None, None, bucket, pack_sorted(key[at][new]), np.where(live, SHARED, owner[at])[new].astype(np.int64).tobytes()))
            return pa.Table.from_batches([batch(out, "part", "chunk", "bucket", "keys", "owners")])

        rows = chunks.mapInArrow(mark, schema("bucket", "chunk", "keys", "owners"))
        for run in self.runs:
            rows = rows.unionByName(run.select("bucket", F.lit(None).cast("long").alias("chunk"), "keys", "owners"))
        merged = materialize(rows.groupBy("bucket").applyInArrow(merge, schema("part", "chunk", "bucket", "keys", "owners")), "merged")
        self.scratch.append(merged)
        self.runs.append(merged.where("owners is not null").select("bucket", "keys", "owners"))
        if len(self.runs) > RUNS:
            self.compact()
        return merged.where("owners is null").select("part", "chunk", "keys")

    def compact(self) -> None:
        def one(table):
            key = np.concatenate([unpack_sorted(k) for k in table["keys"].to_pylist()])
            owner = np.concatenate([np.frombuffer(o, np.int64) for o in table["owners"].to_pylist()])
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return pa.Table.from_batches([batch([(table["bucket"][0].as_py(), pack_sorted(key[at]), np.minimum.reduceat(owner, at).tobytes())], "bucket", "keys", "owners")])

        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.unionByName(run)
        self.runs = [materialize(rows.groupBy("bucket").applyInArrow(one, schema("bucket", "keys", "owners")), "run")]
        self.scratch.append(self.runs[0])


def told_repeats(index: FingerprintIndex, chunks: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """part, chunk, keys, owners: for each of chunks its windows (first hashes, checks) that an earlier chunk has; and bucket,
    chunk, keys, owners: all windows under shared fingerprints with the first chunk that has each. Only windows under shared
    fingerprints are compared, by 96 bits. Of chunks of earlier calls only those are read that one of them has just come to share."""
    window, buckets, first_new, kept = index.window, index.buckets, index.call << CALL, bool(index.folder)

    def under_shared(mine, shared):
        told: dict[int, list[np.ndarray]] = {}
        for chunk, keys in zip(shared["chunk"].to_pylist(), shared["keys"].to_pylist()):
            told.setdefault(chunk, []).append(unpack_sorted(keys))
        out = []
        for chunk, payload in zip(*[mine[c].to_pylist() for c in ("chunk", "payload")]):
            if chunk not in told:
                continue
            c = Chunk(payload, window)
            keys = np.sort(np.concatenate(told[chunk]))
            print_of = c.fingerprints()
            at = np.minimum(np.searchsorted(keys, print_of), len(keys) - 1)
            some = keys[at] == print_of
            first, check = c.first[some], c.check()[some]
            order = np.lexsort((check, first))
            first, check = first[order], check[order]
            new = np.r_[True, (first[1:] != first[:-1]) | (check[1:] != check[:-1])] if len(first) else np.zeros(0, bool)
            first, check = first[new], check[new]
            out += [(of, chunk, pack_sorted(first[i:j]), check[i:j].tobytes()) for of, i, j in bucketed(first, buckets)]
        return pa.Table.from_batches([batch(out, "bucket", "chunk", "keys", "owners")])

    def by_chunk(chunk, first, check):
        order = np.argsort(chunk, kind="stable")
        chunk, first, check = chunk[order], first[order], check[order]
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
        for i, j in zip(cuts, [*cuts[1:], len(chunk)]):
            yield int(chunk[i]), pack_sorted(first[i:j]), check[i:j].tobytes()

    def earliest(table):
        chunk, first, check = [], [], []
        for c, k, o in zip(*[table[c].to_pylist() for c in ("chunk", "keys", "owners")]):
            first.append(unpack_sorted(k))
            check.append(np.frombuffer(o, np.uint32))
            chunk.append(np.full(len(first[-1]), c))
        chunk, first, check = map(np.concatenate, (chunk, first, check))
        order = np.lexsort((chunk, check, first))
        chunk, first, check = chunk[order], first[order], check[order]
        later = np.r_[False, (first[1:] == first[:-1]) & (check[1:] == check[:-1])]
        tell, bucket = later & (chunk >= first_new), table["bucket"][0].as_py()
        out = [(c >> PART, c, None, k, o) for c, k, o in by_chunk(chunk[tell], first[tell], check[tell])]
        out += [(None, c, bucket, k, o) for c, k, o in by_chunk(chunk[~later], first[~later], check[~later])] if kept else []
        return pa.Table.from_batches([batch(out, "part", "chunk", "bucket", "keys", "owners")])

    fields = schema("bucket", "chunk", "keys", "owners")
    rows = chunks.groupBy("part").cogroup(live.where(F.col("chunk") >= first_new).groupBy("part")).applyInArrow(under_shared, fields)
    for old in index.old:
        some = old.join(live.select("chunk").distinct(), "chunk", "left_semi")
        rows = rows.unionByName(some.groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(under_shared, fields))
    if index.windows is not None:
        rows = rows.unionByName(index.windows)
    found = materialize(rows.groupBy("bucket").applyInArrow(earliest, schema("part", "chunk", "bucket", "keys", "owners")), "told")
    index.scratch.append(found)
    return found.where("part is not null").select("part", "chunk", "keys", "owners"), found.where("part is null").select("bucket", "chunk", "keys", "owners")


def deduplicated(docs: DataFrame, window: int = 13, batches: int = 3, texts: bool = False, folder: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, if texts) for every row of docs (doc_id long, text).

    A word goes if it lies in a run of `window` consecutive words that also starts in a document with a smaller doc_id;
    the input, not what is left of it, decides. A null doc_id is smaller than all others; rows of one doc_id don't
    judge each other; null texts and texts shorter than a window keep what they have; an empty table gives no rows. doc_id
    must be a whole number, or a string of one. Documents enter the index in `batches` batches; however often a passage
    occurs, a chunk names it once. There are as many parts and ranges of hashes as the size of the texts asks for.

    With a folder (one that driver and executors share) the index is kept there: documents of earlier calls on it count as
    smaller than all of docs, whatever their doc_id, and docs are added to it. The chunks of earlier calls are scanned for those
    that come to share a passage for the first time, and saving writes the whole run: a call costs what the index holds, not only
    what is new. One call at a time may use a folder; nothing keeps a second one out."""
    spark = docs.sparkSession
    n = parts_of(docs, "text", PART_BYTES)
    index = FingerprintIndex.open(spark, folder, n, window) if folder else FingerprintIndex(n, window)
    chunks, name = chunked(docs, window, n, index.call)
    live = None
    for i in range(batches):
        new = index.add(chunks.where(F.floor(F.col("part").bitwiseAND((1 << CALL - PART) - 1) * batches / n) == i))
        live = new if live is None else live.unionByName(new)
    told, windows = told_repeats(index, chunks, live)

    def final(mine, others):
        known: dict[int, list] = {}
        for chunk, keys, checks in zip(*[others[c].to_pylist() for c in ("chunk", "keys", "owners")]):
            known.setdefault(chunk, []).append((unpack_sorted(keys), np.frombuffer(checks, np.uint32)))
        tables = []
        for chunk, payload in zip(mine["chunk"].to_pylist(), mine["payload"].to_pylist()):
            c = Chunk(payload, window)
            t = known.get(chunk, [])
            gone = c.removed(c.repeats(np.concatenate([x for x, _ in t]) if t else np.zeros(0, U), np.concatenate([x for _, x in t]) if t else np.zeros(0, np.uint32)))
            words, kept = c.words, []
            for a, b in zip(c.offsets[:-1], c.offsets[1:]):
                kept.append(b" ".join([words[i] for i in c.codes[a:b][~gone[a:b]].tolist()]))
            total = np.r_[0, np.cumsum(gone)]
            columns = {"doc_id": c.ids, "n_words": pa.array(np.diff(c.offsets), pa.int64()), "n_removed": pa.array(total[c.offsets[1:]] - total[c.offsets[:-1]], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
            tables.append(pa.table(columns | ({"kept": pa.array([x.decode() for x in kept])} if texts else {})))
        return pa.concat_tables(tables) if tables else pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *((("kept", pa.string()),) if texts else ()))})

    out = materialize(chunks.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(final, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts), "deduplicated")
    if folder:
        index.save(chunks, windows)
    chunks._scratch = f"{scratch_root(spark)}/quillmere/{name}"
    discard(chunks, *index.scratch)
    spark.sql(f"DROP TABLE {name}")
    return out
