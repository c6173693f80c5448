"""N-gram Jaccard join: adaptive multi-match prefixes find candidates, whole sets verify them in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.common import binary_texts, discard, grams, materialize, mixed, pack_sorted, parts_of, slices, unpack_sorted, word_hashes
from quillmere.llm.components import components

#: Most frequent shingles whose counts order prefixes; all others count as rare. A bound of what is broadcast, not of what is joined.
FREQUENT = 1 << 16
#: Bytes of text whose shingles one task counts, distinct ones that it holds, and bits of a hash that tell counted shingles apart.
#: Shingles that share those bits share their count, which orders prefixes and decides no link.
COUNT_BYTES, HELD, COUNTED = 32 << 20, 1 << 20, 40
#: Most shared tokens that a prefix may ask for, and the cost of a verification against that of a list entry.
LONGEST, VERIFY = 64, 4.0
#: Sets and shingles that a block has on average, at most.
BLOCK_SETS, BLOCK_SHINGLES = 128, 1 << 17
#: Bits of the filter of candidates that saves shuffling texts; beyond them it merely passes more.
BITS = 1 << 22
#: Ids that are broadcast to drop documents; beyond them a join that shuffles takes over.
SENT = 1 << 20
U = np.uint64


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct k-word shingles; of fewer words, the whole sequence; of none, nothing."""
    w, offsets = word_hashes(binary_texts(texts), True)
    g = grams(w, k)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(mixed(grams(w[a:b], int(b - a)) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def class_key(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set: two sums of mixed hashes, with the size mixed in."""
    if not len(s):
        return None
    n = U(len(s))
    return np.array([mixed(s).sum() + n, mixed(s * U(0x9E3779B97F4A7C15) + U(1)).sum() ^ n], U).tobytes()


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (their first COUNTED bits) and counts of the FREQUENT shingles that most of docs hold. All shingles of all texts
    are counted: tasks hand their distinct ones on, packed, by ranges of hashes, and a task sums a range."""
    parts = parts_of(docs, "text", COUNT_BYTES)

    def hand_on(batches):
        def packed():
            key, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            times = np.bincount(of, np.concatenate([x for _, x in held])).astype(np.uint32)
            edges = ((np.arange(parts, dtype=np.uint64) << U(COUNTED)) // U(parts)) if parts < 1 << (64 - COUNTED) else (np.arange(parts) * (2.0**COUNTED / parts)).astype(U)
            cuts = np.r_[np.searchsorted(key, edges), len(key)]
            some = [(p, i, j) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _, _ in some], pa.int64()), "keys": pa.array([pack_sorted(key[i:j]) for _, i, j in some], pa.binary()), "times": pa.array([times[i:j].tobytes() for _, i, j in some], pa.binary())})

        held, size = [], 0
        for batch in batches:
            texts = batch.column("text")
            for at, n in slices(texts):
                held.append(np.unique(np.concatenate(shingle_sets(texts.slice(at, n), k)) >> U(64 - COUNTED), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def total(table):
        key = np.concatenate([unpack_sorted(x.as_py()) for x in table["keys"]])
        order = np.argsort(key)
        key = key[order]
        times = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["times"]])[order]
        del order
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, n = key[first], np.add.reduceat(times, first, dtype=np.int64)
        del times, first
        top = np.lexsort((key, -n))[:FREQUENT]
        top = top[n[top] > 1]
        return pa.table({"key": key[top].view(np.int64), "n": n[top]})

    found = docs.select("text").mapInArrow(hand_on, "part long, keys binary, times binary").groupBy("part").applyInArrow(total, "key long, n long")
    top = found.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key, n = np.asarray(top["key"]).view(U), np.asarray(top["n"], dtype=np.float64)
    order = np.argsort(key)
    return key[order], n[order]


def prefix(s: np.ndarray, known: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[int, np.ndarray]:
    """(shared tokens asked for, prefix) of a sorted set. Two sets of which one has n shingles, alike by percent, share
    ceil(percent * n / 100) or more; so of the first n - that + l by any common order they share l or more. l is what
    makes list entries, and candidates that are in l lists, cheapest by the counts known."""
    key, count = known
    df = np.ones(len(s))
    if len(key):
        short = s >> U(64 - COUNTED)
        at = np.minimum(np.searchsorted(key, short), len(key) - 1)
        df = np.where(key[at] == short, count[at], 1.0)
    order = np.lexsort((s, df))
    shared = -(-percent * len(s) // 100)
    spare = len(s) - shared
    l = np.arange(1, min(LONGEST, shared) + 1)
    best = int(np.argmin(np.cumsum(df[order[: spare + LONGEST]])[spare + l - 1] * (1 + VERIFY / l))) + 1
    return best, s[order[: spare + best]]


ROWS = [T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("asked", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]


def prefixes(docs: DataFrame, sent, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, cls, asked, tokens of every row of docs; sent: the counts that are known."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def cut(batches):
        for batch in batches:
            for at, n in slices(batch.column("text")):
                sets = shingle_sets(batch.column("text").slice(at, n), k)
                found = [prefix(s, sent.value, percent) if len(s) else (0, s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, n) for c in ("doc_id", "text_key")), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary()),
                    pa.array([a for a, _ in found], pa.int64()), pa.array([t.view(np.int64) for _, t in found], pa.list_(pa.int64()))], names=["doc_id", "text_key", *(f.name for f in ROWS)])

    return rows.mapInArrow(cut, T.StructType([rows.schema["doc_id"], rows.schema["text_key"], *ROWS]))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (rep, text_key and others) with text, one row each. A bitmap of BITS bits, joined natively, keeps most other
    texts from being shuffled; what it lets through falls to the join. Texts shuffle in fewer bytes than their shingles."""
    def bit(c):
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    bitmap = wanted.select(bit("rep").alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    bitmap = materialize(bitmap, "bitmap")  # at most BITS / 64 rows
    at = docs.select(F.col("doc_id").alias("t_id"), "text").withColumn("_bit", bit("t_id"))
    at = at.join(F.broadcast(bitmap), F.floor(F.col("_bit") / 64) == F.col("word")).where(F.getbit("mask", (F.col("_bit") % 64).cast("int")) == 1)
    at = at.select("t_id", F.xxhash64("text").alias("t_key"), "text")
    return at.join(wanted, (F.col("t_id") == F.col("rep")) & (F.col("t_key") == F.col("text_key"))).dropDuplicates(["t_id", "t_key"]).drop("t_id", "t_key", "rep", "text_key")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of incidence matrices, in parts."""
    out = np.zeros((len(a), len(b)), np.float32)
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    if not len(both):
        return out

    def incidence(flat, sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[col] == flat
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    (ra, ca), (rb, cb) = incidence(fa, a), incidence(fb, b)
    for at in range(0, len(both), 8192):
        parts = []
        for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            lo, hi = np.searchsorted(c, (at, at + 8192))
            m = np.zeros((n, 8192), np.float32)
            m[r[lo:hi], c[lo:hi] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def fitting(n: np.ndarray, asked: np.ndarray, tokens, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets at left and which at right can link: sizes fit, and prefixes share what the less demanding asks for."""
    shared = overlaps([tokens[i] for i in left], [tokens[i] for i in right])
    na, nb = n[left][:, None], n[right][None, :]
    return (shared >= np.minimum(asked[left][:, None], asked[right][None, :])) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (left[:, None] != right[None, :])


def linked(sets, fits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as places, of the links between the sets at left and those at right that fit."""
    rows, cols = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
    if not len(rows):
        return []
    inter = overlaps([sets[i] for i in left[rows]], [sets[i] for i in right[cols]])
    n = np.array([len(s) for s in sets])
    union = n[left[rows]][:, None] + n[right[cols]][None, :] - inter
    link = fits[np.ix_(rows, cols)] & (100 * inter >= percent * union)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(link)):
        a, b = root(left[rows[i]]), root(right[cols[j]])
        if a != b:
            parent[a] = b
            out.append((left[rows[i]], right[cols[j]]))
    return out


def verified(groups: DataFrame, sent, k: int, percent: int) -> DataFrame:
    """Links (a, b) within groups (x, y, block, c, text): between the block x and the block y, where these are the same between
    all its rows. Per group at most a forest of its rows, each a whole text that is cut into its set here."""

    def verify(key, table):
        x, y = (v.as_py() for v in key)
        c, block = np.asarray(table["c"]), np.asarray(table["block"])
        texts = table["text"].combine_chunks()
        sets = [s for at, m in slices(texts) for s in shingle_sets(texts.slice(at, m), k)]
        asked, tokens = zip(*(prefix(s, sent.value, percent) for s in sets))
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        fits = fitting(np.array([len(s) for s in sets]), np.array(asked), [np.sort(t) for t in tokens], left, right, percent)
        found = linked(sets, fits, left, right, percent)
        return pa.table({"a": pa.array([c[a] for a, _ in found], pa.int64()), "b": pa.array([c[b] for _, b in found], pa.int64())})

    return groups.select("x", "y", "block", "c", "text").groupBy("x", "y").applyInArrow(verify, "a long, b long")


def involved(groups: DataFrame, percent: int) -> DataFrame:
    """x, y, c: those rows of groups (x, y, block, near, c, n, asked, tokens) that fit a row of the other block which was not in
    one near block with them, so that only their texts need be read."""

    def sift(key, table):
        x, y = (v.as_py() for v in key)
        block = np.asarray(table["block"])
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        tokens = [np.sort(np.array(t, np.int64).view(U)) for t in table["tokens"].to_pylist()]
        near = np.asarray(table["near"])
        fits = fitting(np.asarray(table["n"]), np.asarray(table["asked"]), tokens, left, right, percent) & (near[left][:, None] != near[right][None, :])
        some = np.union1d(left[fits.any(1)], right[fits.any(0)])
        return pa.table({"x": pa.array(np.full(len(some), x), pa.int64()), "y": pa.array(np.full(len(some), y), pa.int64()), "c": pa.array(np.asarray(table["c"])[some], pa.int64())})

    return groups.select("x", "y", "block", "near", "c", "n", "asked", "tokens").groupBy("x", "y").applyInArrow(sift, "x long, y long, c long")


def able(met: DataFrame) -> DataFrame:
    """a_c: classes of met (c, asked, token, least) that share as many tokens as they, or the least demanding class of their
    lists, ask for. No other class can have a partner."""
    enough = met.groupBy(F.col("c").alias("a_c")).agg(F.count_distinct("token").alias("k"), F.min(F.least("asked", "least")).alias("need"))
    return enough.where("k >= need").select("a_c")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """c, asked, token, width, head: prefix tokens that classes of fitting sizes share, of classes that can have a partner;
    head is the least class of such a list. Sizes are cut into widths within which, or the next, two sets that link must
    lie. Counts go before joins, and tokens that one class alone has go first."""
    width = F.floor(F.log("n") / F.lit(np.log(100.0 / percent) * 1.0001)).cast("int")
    entries = classes.select("c", F.col("asked").cast("int").alias("asked"), width.alias("width"), F.explode("tokens").alias("token"))
    shared = entries.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("m"), F.min("asked").alias("least")).where("m > 1").select("t", "least")
    met = materialize(entries.join(shared, F.col("token") == F.col("t")).select("c", "asked", "token", "width", "least"), "met")
    live = materialize(met.join(able(met), F.col("c") == F.col("a_c")).select("c", "asked", "token", F.explode(F.array("width", F.col("width") + 1)).alias("width")), "live")
    discard(met)
    lists = live.groupBy(F.col("token").alias("t"), F.col("width").alias("w")).agg(F.count("*").alias("m"), F.min("asked").alias("least"), F.min("c").alias("head")).where("m > 1")
    met = materialize(live.join(lists, (F.col("token") == F.col("t")) & (F.col("width") == F.col("w"))).select("c", "asked", "token", "width", "least", "head"), "met")
    discard(live)
    live = materialize(met.join(able(met), F.col("c") == F.col("a_c")).select("c", "asked", "token", "width", "head"), "live")
    discard(met)
    return live


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, c, n) with block: each group in as many blocks as its sets and shingles ask for, by a hash of c."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return rows.join(sizes, F.col(group) == F.col("_g")).withColumn("block", F.xxhash64(group, F.pmod(F.hash("c"), F.col("blocks")))).drop("_g")


def far_groups(live: DataFrame, placed: DataFrame, near: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """x, y, block, c of the classes that may link across what near (node, component) holds already: only lists in which two
    components and two near blocks meet count, and of their classes only those that fit one of another block by prefix tokens."""
    comps = near.groupBy(F.col("component").alias("k_c")).agg(F.count("*").alias("members"))
    of = placed.select("c", "n", "family", F.col("block").alias("near")).join(near, F.col("c") == F.col("node"), "left").join(comps, F.col("component") == F.col("k_c"), "left")
    of = of.select("c", "n", "near", F.coalesce("component", "c").alias("comp"), F.coalesce("component", "family").alias("grp"))
    of = materialize(numbered(of, "grp").select(F.col("c").alias("o_c"), "n", "near", "comp", "block"), "far_blocks")
    spots = live.join(of.select("o_c", "comp", "near"), F.col("c") == F.col("o_c")).select("c", "asked", "token", "width", "comp", "near")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "near") for f in (F.min, F.max)]
    lists = spots.groupBy(F.col("token").alias("t"), F.col("width").alias("w")).agg(F.min("asked").alias("least"), *ends).where("min_comp <> max_comp and min_near <> max_near").select("t", "w", "least")
    met = materialize(spots.join(lists, (F.col("token") == F.col("t")) & (F.col("width") == F.col("w"))).select("c", "asked", "token", "width", "least"), "far_met")
    left = materialize(met.join(able(met), F.col("c") == F.col("a_c"), "left_semi").join(of, F.col("c") == F.col("o_c")).drop("o_c"), "far_able")
    spread = left.groupBy("token", "width", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.least("asked", "least")).alias("least"))
    spread = materialize(spread, "spread")
    other = spread.select("token", "width", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi", "least")])
    pairs = spread.join(other, ["token", "width"]).where("block <= block2 and (lo <> hi or lo <> lo2 or lo2 <> hi2)")
    pairs = pairs.groupBy(F.col("block").alias("x"), F.col("block2").alias("y")).agg(F.count_distinct("token").alias("k"), F.min(F.least("least", "least2")).alias("need")).where("k >= need").select("x", "y")
    sides = materialize(pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), "sides")
    signed = left.select("c", "n", "near", "block").distinct().join(classes.select(F.col("c").alias("s_c"), "asked", "tokens"), F.col("c") == F.col("s_c")).drop("s_c")
    some = involved(sides.join(signed, "block"), percent)
    out = materialize(some.join(of.select("o_c", "block"), F.col("c") == F.col("o_c")).select("x", "y", "block", "c"), "far")
    discard(met, left, spread, sides, of)
    return out


def joined(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text): sets of k-word shingles of the lower-cased
    text link where 100 * intersection >= percent * union; component_id is the smallest doc_id that links reach.

    Equal sets are one class from the start; classes, not copies, are joined. Classes whose prefixes share tokens form
    families, which are cut into blocks of about BLOCK_SETS sets. First each block is verified with itself and its family's
    first class. Then only classes of different components that still share enough prefix tokens are, by pairs of
    blocks, never all pairs of rows: their prefixes are compared, and the texts of those that fit are read. Null and
    wordless texts link with nothing and are their own component; repeated rows are copies; a null doc_id takes the
    component of its class, null where that has no other; an empty table gives no rows. Shingles are compared by 64-bit
    hashes, classes by 128 bits."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))  # FREQUENT entries
    rows = materialize(prefixes(docs, sent, k, percent), "prefixes")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), *[F.min(c).alias(c) for c in ("n", "asked", "tokens")])
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("c"), "cls", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "n", "asked", "tokens"), "classes")
    live = candidates(classes, percent)
    family = live.groupBy(F.col("c").alias("f_c")).agg(F.min("head").alias("family"))
    placed = classes.select("c", "rep", "text_key", "n").join(family, F.col("c") == F.col("f_c")).drop("f_c")
    placed = materialize(numbered(placed, "family"), "placed")
    texts = materialize(texts_of(docs, placed.select("c", "rep", "text_key", "family", "block", "blocks")), "texts")
    heads = texts.where("c = family and blocks > 1").select("c", "text", F.col("block").alias("b"))  # a row per family of several blocks
    heads = placed.where("blocks > 1").select("family", F.col("block").alias("x")).distinct().join(heads, F.col("family") == F.col("c")).where("x <> b")
    own = texts.select(F.col("block").alias("x"), "c", "text")
    near = own.unionByName(heads.select("x", "c", "text")).select("x", F.col("x").alias("y"), F.col("x").alias("block"), "c", "text")
    links = materialize(verified(near, sent, k, percent), "near_links")
    comp = materialize(components(links), "near_components")
    far = far_groups(live, placed, comp, classes, percent)
    more = verified(far.join(texts.select(F.col("c").alias("t_c"), "text"), F.col("c") == F.col("t_c")), sent, k, percent)
    links = links.unionByName(materialize(more, "far_links"))
    comp = materialize(components(links), "components")
    least = comp.join(classes.select("c", "rep"), F.col("node") == F.col("c")).groupBy(F.col("component").alias("l_c")).agg(F.min("rep").alias("least"))
    named = classes.select(F.col("cls").alias("c_cls"), "c", "rep").join(comp, F.col("c") == F.col("node"), "left").join(least, F.col("component") == F.col("l_c"), "left")
    named = materialize(named.select("c_cls", F.coalesce("least", "rep").alias("component_id")), "named")
    out = rows.select("doc_id", "n", "cls").join(named, F.col("cls") == F.col("c_cls"), "left")
    out = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id")), "joined")
    discard(rows, classes, live, placed, texts, far, comp, named)
    return out


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their component: the smallest doc_id's, one row of each of its texts. Columns
    unchanged. Rows with a null doc_id stay. Texts are shuffled only where more than SENT ids are to go."""
    of = joined(docs, k, percent).where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k_id")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows"))
    of = materialize(of.where("not stays or rows > 1"), "dropped")

    def sent(ids):
        return F.broadcast(ids) if of.count() <= SENT else ids

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    single = rows.join(sent(of.select("k_id")), F.col("id") == F.col("k_id"), "left_anti").select("row")
    more = rows.join(sent(of.where("stays").select("k_id")), F.col("id") == F.col("k_id"), "left_semi")
    more = more.withColumn("key", F.xxhash64("row.text")).dropDuplicates(["id", "key"]).select("row")
    return single.unionByName(more).select("row.*")
