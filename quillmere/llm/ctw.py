"""Language-model scores by context-tree weighting over bytes, each byte coded as eight binary decisions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import binary_texts, byte_list, discard, hashes, materialize, mixed, pack_sorted, parts_for, shuffle_partitions, slices, split_words, unpack_sorted

#: Bytes of context. A gram is the context's bytes, oldest first, and the byte they precede.
DEPTH = 5
#: Grams, or words, of the model in a bucket, on average; and bytes of text whose questions a task answers from one bucket.
ENTRIES, ASKED = 1 << 20, 32 << 20
#: Distinct grams that a task gathers before it hands them on.
HELD = 1 << 21
END = b"\n"
U = np.uint64


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the model codes, and where each text's begin: A-Z lower-cased, words joined by one space, an end."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(binary_texts(texts))))
    start, space, end, none = (pa.scalar(x, pa.large_string()) for x in (END.decode() * DEPTH, " ", END.decode(), ""))
    joined = pc.binary_join_element_wise(start, pc.binary_join(lists, space), end, none)
    sizes = np.asarray(pc.binary_length(joined), dtype=np.int64)
    return np.frombuffer(b"".join(byte_list(joined)), np.uint8), np.r_[0, np.cumsum(sizes)]


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each coded byte's gram and, per text, where its grams begin. A text's first bytes follow DEPTH ends."""
    b, at = stream(texts)
    g = np.zeros(max(0, len(b) - DEPTH), U)
    for i in range(DEPTH + 1):
        g = (g << U(8)) | b[i : i + len(g)]
    inside = np.ones(len(b), bool)
    inside[(at[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return g[inside[DEPTH:]], at - DEPTH * np.arange(len(at))


def lgamma(x: np.ndarray) -> np.ndarray:
    low = np.log(x)
    for i in range(1, 8):
        low = low + np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def weighed(n0, n1, below):
    """Log of the weighted probability of inner nodes, and the share of each one's own estimate in it."""
    own = kt(n0, n1) - math.log(2)
    whole = np.logaddexp(own, below - math.log(2))
    return whole, np.exp(own - whole)


class Level:
    """The nodes of one depth for one bit place: keys (context << 8 | bits before), counts, estimate, parents."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.key, self.of = np.unique(key, return_inverse=True)
        k = len(self.key)
        self.n0, self.n1 = np.bincount(self.of, n0, k), np.bincount(self.of, n1, k)
        if below is None:
            self.log, self.own = kt(self.n0, self.n1), np.ones(k)
        else:
            self.log, self.own = weighed(self.n0, self.n1, np.bincount(self.of, below, k))
        self.one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)
        self.seen = self.n0 + self.n1 > 0


def levels(grams: np.ndarray, n: np.ndarray, place: int, top: int) -> list[Level]:
    """Levels of depth DEPTH down to `top` for one bit place; each level's `of` points from the level before."""
    x = grams & U(255)
    node = (U(1) << U(place)) | (x >> U(8 - place))
    bit = ((x >> U(7 - place)) & U(1)).astype(np.float64)
    out = [Level((grams >> U(8) << U(8)) | node, n * (1 - bit), n * bit, None)]
    for depth in range(DEPTH - 1, top - 1, -1):
        low = out[-1]
        out.append(Level(low.key & U((1 << (8 * depth + 8)) - 1), low.n0, low.n1, low.log))
    return out


def mixed_down(found: list[Level], upper: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Probability of a one for each node of the deepest level: from the root down, a node's own estimate by its share,
    the rest by its child on the path; where the child never occurred in training, the node's own alone."""
    deep = found[0]
    p, seen, at = deep.one.copy(), deep.seen.copy(), np.arange(len(deep.key))
    for level in found[1:]:
        at = level.of[at]
        own = np.where(seen, level.own[at], 1.0)
        p, seen = own * level.one[at] + (1 - own) * p, level.seen[at]
    key = deep.key
    for depth, (own_all, one_all, seen_all) in zip((1, 0), upper):
        i = (key & U((1 << (8 * depth + 8)) - 1)).astype(np.int64)
        own = np.where(seen, own_all[i], 1.0)
        p, seen = own * one_all[i] + (1 - own) * p, seen_all[i]
    return np.where(seen, p, 0.5)


def log_scores(grams: np.ndarray, n: np.ndarray, upper) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    out = np.zeros(len(grams))
    for place in range(8):
        found = levels(grams, n, place, 2)
        p = mixed_down(found, upper)[found[0].of]
        bit = ((grams >> U(7 - place)) & U(1)).astype(bool)
        out += np.log10(np.where(bit, p, 1 - p))
    return out


def counted(docs: DataFrame, trained) -> DataFrame:
    """kind (0 grams, 1 hashes of words, 2 documents), key, n: distinct ones of all docs, with occurrences in those for
    which the column `trained` holds. Tasks sum what they read before it is shuffled."""
    rows = docs.select("text", trained.alias("trained"))

    def gather(batches):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def summed(parts):
            key, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return key, np.bincount(of, np.concatenate([n for _, n in parts]), len(key))

        def rows(kind, part):
            key, n = part
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        documents = 0
        for batch in batches:
            used = np.asarray(pc.fill_null(batch.column("trained"), False).cast(pa.int8()), dtype=bool)
            documents += int(used.sum())
            for at, k in slices(batch.column("text")):
                texts, on = batch.column("text").slice(at, k), used[at : at + k]
                g, begin = codes(texts)
                mask = np.repeat(on, np.diff(begin))
                for part, n in ((g[mask], 1), (g[~mask], 0)):
                    key, times = np.unique(part, return_counts=True)
                    held[0].append((key, times * n))
                c, words, offsets = split_words(binary_texts(texts), True)
                mask = np.repeat(on, np.diff(offsets))
                held[1].append((hashes(words), np.bincount(c[mask], minlength=len(words))))
                for kind in (0, 1):
                    if sum(len(key) for key, _ in held[kind]) > HELD:
                        held[kind] = [summed(held[kind])]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield rows(kind, held[kind][0])
                            held[kind] = []
        for kind in (0, 1):
            if held[kind]:
                yield rows(kind, summed(held[kind]))
        yield rows(2, (np.zeros(1, U), np.array([documents])))

    return rows.mapInArrow(gather, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def read_all(batches) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.asarray(b.column("key"), dtype=np.int64), np.asarray(b.column("n"), dtype=np.int64)) for b in batches]
    if not parts:
        return np.zeros(0, U), np.zeros(0)
    return np.concatenate([k for k, _ in parts]).view(U), np.concatenate([n for _, n in parts]).astype(np.float64)


def upper_levels(grams: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Depths 1 and 0, from all subtrees of depth 2: for each possible node its own share, estimate and whether it was
    seen. At most 256 * 255 rows reach the driver, however large the corpus."""

    def subtrees(batches):
        key, n = read_all(batches)
        for place in range(8):
            if len(key):
                top = levels(key, n, place, 2)[-1]
                yield pa.RecordBatch.from_arrays([pa.array((top.key & U(0xFFFF)).astype(np.int64)), pa.array(top.n0), pa.array(top.n1), pa.array(top.log)], names=["node", "n0", "n1", "log"])

    rows = grams.mapInArrow(subtrees, "node long, n0 double, n1 double, log double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log")]).toArrow()
    node = np.asarray(rows["node"], dtype=np.int64)
    n0, n1, below = (np.asarray(rows[c], dtype=np.float64) for c in ("n0", "n1", "log"))
    out = []
    for size in (1 << 16, 1 << 8):
        i = node & (size - 1)
        n0, n1, below = (np.bincount(i, x, size) for x in (n0, n1, below))
        node = np.arange(size)
        whole, own = weighed(n0, n1, below)
        out.append((own, (n1 + 0.5) / (n0 + n1 + 1.0), n0 + n1 > 0))
        below = whole
    return out


def model(counts: DataFrame, n: int) -> DataFrame:
    """key, score: the log10 probability of every distinct gram of counts (as counted() gives them) under the tree of the trained
    ones. Subtrees of two context bytes meet in one of n tasks each, as distinct grams."""
    grams = counts.where("kind = 0").select("key", "n").repartition(n, F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF))
    sent = counts.sparkSession.sparkContext.broadcast(upper_levels(grams))  # 2^16 + 2^8 nodes

    def score(batches):
        key, n = read_all(batches)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(log_scores(key, n, sent.value))], names=["key", "value"])

    return grams.mapInArrow(score, "key long, value double")


class Table:
    """An open-addressing hash table of numpy arrays: 64-bit keys to floats."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        bits = max(4, int(2 * len(key)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key, self.value, self.full = np.zeros(1 << bits, U), np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool)
        todo, at = np.arange(len(key)), (mixed(key) >> self.shift).astype(np.int64)
        while len(todo):
            free = ~self.full[at]
            slot, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.key[slot], self.value[slot], self.full[slot] = key[won], value[won], True
            lost = np.ones(len(todo), bool)
            lost[np.flatnonzero(free)[first]] = False
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def __call__(self, key: np.ndarray, absent: float) -> np.ndarray:
        out = np.full(len(key), absent, np.float32)
        at = (mixed(key) >> self.shift).astype(np.int64)
        hit = self.key[at] == key
        hit &= self.full[at]
        out[hit] = self.value[at[hit]]
        todo = np.flatnonzero(~hit & self.full[at])
        at = (at[todo] + 1) & self.mask
        while len(todo):
            full = self.full[at]
            hit = full & (self.key[at] == key[todo])
            out[todo[hit]] = self.value[at[hit]]
            on = full & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


def per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return sums[begin[1:]] - sums[begin[:-1]]


def chunked(rows: DataFrame) -> DataFrame:
    """chunk, size, payload: rows as they lie, about 4 MB of text a chunk, one row at least."""

    def cut(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, k in slices(batch.column("text")):
                part, sink = pa.Table.from_batches([batch.slice(at, k)]), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                size = pc.sum(pc.binary_length(part["text"])).as_py() or 0
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size + k]), pa.array([sink.getvalue().to_pybytes()])], names=["chunk", "size", "payload"])
                chunk += 1

    return rows.mapInArrow(cut, "chunk long, size long, payload binary")


class Chunk:
    """The rows of a chunk with their grams and words, and the distinct ones of both in ascending order."""

    def __init__(self, payload: bytes) -> None:
        self.rows = pa.ipc.open_stream(payload).read_all().combine_chunks()
        texts = self.rows["text"].combine_chunks()
        self.codes, self.begin = codes(texts)
        self.words, distinct, self.offsets = split_words(binary_texts(texts), True)
        self.hashes = hashes(distinct)
        self.keys = np.unique(self.codes), np.unique(self.hashes)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((mixed(key) >> U(32)) * U(n) >> U(32)).astype(np.int32)


def dealt(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket, ascending in each, and where each of the n buckets begins in it."""
    of = bucket_of(key, n)
    return np.argsort(of, kind="stable"), np.r_[0, np.cumsum(np.bincount(of, minlength=n))]


def asked(chunks: DataFrame, n: int) -> DataFrame:
    """bucket, chunk, grams, words: the distinct grams and words of each chunk, a row for each bucket that has any."""

    def ask(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
                keys = Chunk(payload).keys
                (go, g), (wo, w) = (dealt(k, n) for k in keys)
                some = np.flatnonzero((np.diff(g) > 0) | (np.diff(w) > 0))
                packed = [[pack_sorted(k[o[at[i] : at[i + 1]]]) for i in some] for k, o, at in ((keys[0], go, g), (keys[1], wo, w))]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), *(pa.array(x, pa.binary()) for x in packed)], names=["bucket", "chunk", "grams", "words"])

    return chunks.mapInArrow(ask, "bucket int, chunk long, grams binary, words binary")


def entries(table: DataFrame, what: int, n: int) -> DataFrame:
    """bucket, what, key, value of the entries (key, value) of a table."""

    def place(batches):
        for batch in batches:
            key = np.asarray(batch.column("key"), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(key.view(U), n)), pa.array(np.full(len(key), what, np.int32)), pa.array(key), batch.column("value").cast(pa.float64())], names=["bucket", "what", "key", "value"])

    return table.mapInArrow(place, "bucket int, what int, key long, value double")


def answered(grams: DataFrame, words: DataFrame, chunks: DataFrame, n: int, salts: int) -> DataFrame:
    """chunk, bucket, scores, counts: what the model has for each of the keys asked, in their order; 0 for what it lacks.

    A task reads its bucket's entries, sorted before the questions, and then one question after another, so it holds a bucket
    and a batch. A bucket's questions are dealt to `salts` tasks, each with the bucket's entries."""
    model = entries(grams, 0, n).unionByName(entries(words, 1, n)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asks = asked(chunks, n).withColumns({"what": F.lit(2), "salt": F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")})
    both = model.unionByName(asks, allowMissingColumns=True).repartition(n * salts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "what")

    def answer(batches):
        now, held, ready = None, ([], []), None

        def found(which, packed, kind):
            keys, (key, value) = unpack_sorted(packed), ready[which]
            at = np.minimum(np.searchsorted(key, keys), max(0, len(key) - 1))
            return (np.where(key[at] == keys, value[at], 0.0) if len(key) else np.zeros(len(keys))).astype(kind).tobytes()

        for batch in batches:
            group = np.asarray(batch.column("bucket"), dtype=np.int64) * salts + np.asarray(batch.column("salt"), dtype=np.int64)
            what = np.asarray(batch.column("what"))
            ends = np.flatnonzero(np.r_[(group[1:] != group[:-1]) | (what[1:] != what[:-1]), True]) + 1 if len(what) else []
            out = []
            for a, b in zip([0, *ends[:-1]], ends):
                if group[a] != now:
                    now, held, ready = group[a], ([], []), None
                if what[a] < 2:
                    held[what[a]].append([np.asarray(batch.column(c).slice(a, b - a)) for c in ("key", "value")])
                    continue
                if ready is None:
                    ready = []
                    for parts in held:
                        key, value = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0) for i in (0, 1))
                        key = key.astype(np.int64).view(U)
                        order = np.argsort(key)
                        ready.append((key[order], value[order]))
                    held = ([], [])
                some = batch.slice(a, b - a)
                for bucket, chunk, g, w in zip(*[some.column(c).to_pylist() for c in ("bucket", "chunk", "grams", "words")]):
                    out.append((chunk, bucket, found(0, g, np.float32), found(1, w, np.float64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "bucket", "scores", "counts"])

    return both.mapInArrow(answer, "chunk long, bucket int, scores binary, counts binary")


def scores(docs: DataFrame, held_out) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte. The models learn from the rows for which held_out (a column) is not true.

    score is the log10 probability of the text's tokens by the tree: A-Z lower-cased, words joined by a space, then an
    end. base_score is the smoothed unigram one. Both models hold what all documents have, and grow with them. They stay
    tables: chunks of texts ask buckets of them for their distinct grams and words, and sum the answers, in one pass.
    Null texts are empty (their end alone); rows of one doc_id and text score alike; an empty table gives no rows. A text
    longer than a chunk is one of its own."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialize(counted(rows, ~F.col("held_out")), "counts")
    of = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.count("*").alias("k")).collect()}  # a row per kind
    ends = of[2]["n"] if 2 in of else 0
    total = (of[1]["n"] if 1 in of else 0) + ends
    distinct = (of[1]["v"] if 1 in of else 0) + (ends > 0)
    n = parts_for(max(of[0]["k"] if 0 in of else 0, distinct), ENTRIES, shuffle_partitions(spark))
    grams = materialize(model(counts, n), "grams")
    chunks = materialize(chunked(rows), "chunks")
    salts = parts_for(chunks.agg(F.sum("size").alias("n")).first()["n"] or 0, ASKED * n, 1)
    answers = answered(grams, counts.where("kind = 1 and n > 0").select("key", F.col("n").cast("double").alias("value")), chunks.select("chunk", "payload"), n, salts)
    kind = dict(docs.dtypes)["doc_id"]

    def summed(mine, told):
        def smooth(c):
            return np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))

        chunk = Chunk(mine["payload"][0].as_py())
        told = told.sort_by("bucket")
        values = []
        for key, column, dtype in zip(chunk.keys, ("scores", "counts"), (np.float32, np.float64)):
            value = np.empty(len(key))
            value[dealt(key, n)[0]] = np.frombuffer(b"".join(told[column].to_pylist()), dtype)
            values.append(value)
        c = values[1][np.searchsorted(chunk.keys[1], chunk.hashes)]
        known = np.r_[0, np.cumsum((c > 0)[chunk.words])]
        size, tokens = np.diff(chunk.begin), np.diff(chunk.offsets) + 1
        log = per_text(Table(chunk.keys[0], values[0])(chunk.codes, 0.0), chunk.begin)
        base = per_text(smooth(c)[chunk.words], chunk.offsets) + smooth(ends)
        columns = {"doc_id": chunk.rows["doc_id"], "held_out": chunk.rows["held_out"], "n_tokens": pa.array(tokens, pa.int64())}
        columns |= {"n_known": pa.array(known[chunk.offsets[1:]] - known[chunk.offsets[:-1]] + (ends > 0), pa.int64()), "train_tokens": pa.array(np.full(len(size), total), pa.int64())}
        return pa.table(columns | {"base_score": pa.array(base), "score": pa.array(log), "bits_per_byte": pa.array(-log * math.log2(10) / size)})

    out = chunks.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(summed, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    out = materialize(out, "scores")
    discard(counts, grams, chunks)
    return out
