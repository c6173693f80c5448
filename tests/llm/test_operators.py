"""Each operator against a brute-force version over a small table, and on odd input."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF
from odd_rows import docs, odd  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.llm import components, ctw, decontaminate, jaccard, mixing, queries, repair, substring, toxicity, url_filter, vafile, warc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return (text or "").encode().lower().decode()


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    root = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    assert queries.QUERIES[name](spark, root).count() == 0


def test_mixing(spark, docs):
    m = mixing.mixture(docs).toPandas()
    again = mixing.mixture(docs.repartition(3)).toPandas()
    assert sorted(map(tuple, m[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    m["source"] = m.doc_id.map(source)
    g = m.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    want = {s: w for s, w in zip(sorted(g.index), [3, 1, 2] * 10)}
    left, target = 1.5 * g["size"].sum(), {}
    open_ = set(g.index)
    while True:
        over = {s for s in open_ if left * want[s] / sum(want[x] for x in open_) > 2 * g["size"][s]}
        if not over:
            break
        target |= {s: 2.0 * g["size"][s] for s in over}
        left -= sum(2.0 * g["size"][s] for s in over)
        open_ -= over
    target |= {s: left * want[s] / sum(want[x] for x in open_) for s in open_}
    for s in g.index:
        assert math.isclose(g.target[s], target[s]) and abs(g.taken[s] - target[s]) <= g.most[s]
    assert (m.taken <= 2 * m["size"]).all() and (m.taken % m["size"].clip(1) == 0).all()


def test_mixing_odd(spark, odd):
    m = mixing.mixture(odd)
    assert m.count() == odd.count() and m.where("taken > 2 * size").count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def brute_contamination(docs, items):
    w = collections.defaultdict(set)
    for i, t in items:
        x = WORD.findall(lowered(t))
        for a in range(max(1, len(x) - 12) if x else 0):
            w[tuple(x[a : a + 13])].add(i)
    out = []
    for d, t in docs:
        x, hit, of = WORD.findall(lowered(t)), set(), set()
        for n in {len(k) for k in w}:
            for a in range(len(x) - n + 1):
                if s := w.get(tuple(x[a : a + n])):
                    hit |= set(range(a, a + n))
                    of |= s
        out.append((d, len(x), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(x)))
    return sorted(out, key=repr)


def test_decontaminate(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = spark.createDataFrame([(100, "one"), (101, "a B"), (102, None), (103, ""), (104, "a b c"), (100, "one")], "item_id long, text string").unionByName(items)
    for d, i in ((docs, short), (odd, short), (docs, items)):
        got = sorted((tuple(r) for r in decontaminate.contamination(d, i).drop("text_key").collect()), key=repr)
        assert got == brute_contamination([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in i.select("item_id", "text").collect()])
    assert decontaminate.clean(odd, short).columns == odd.columns


def test_decontaminate_null_item(spark):
    """A null item_id hits words, but has no name among the items; a window that several items share names them all."""
    docs = spark.createDataFrame([(1, "x y z"), (2, "p q r"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "X y"), (7, "q"), (8, "Q"), (8, "Q")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {1: (3, 2, 0, digest(b""), True), 2: (3, 1, 2, digest(b"7,8"), True), 3: (0, 0, 0, digest(b""), False)}


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 400)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=repr) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=6))
def test_repair_round_trip(docs_ids):
    ids = np.array([x for d in docs_ids for x in [*d, 2]], np.uint32)
    ends = np.cumsum([len(d) + 1 for d in docs_ids])
    b = repair.Block(repair.packed(ids, ends))
    assert (b.ids() == ids).all()
    for i, d in enumerate(docs_ids):
        assert b.ids(i).tolist() == [*d, 2]
    for a in range(0, len(ids), 7):
        assert b.span(a, min(len(ids), a + 9)).tolist() == ids[a : a + 9].tolist()


def test_repair(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    for d in (docs, odd.where("doc_id is not null")):
        rows = sorted(tuple(r) for r in d.select("doc_id", F.coalesce("text", F.lit(""))).collect())
        want, at = [], 0
        for (i, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False)):
            ids = np.array([*e.ids, 2], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(tuple, repair.written(d, queries.tokenizer_path()).collect())) == want
    assert repair.written(odd, queries.tokenizer_path()).count() == odd.count()


def test_encoder_odd_words():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["it's don't, A-b.c 12,3!! \x1c z\xa0q İI ΣΑΣ. <|ENDOFTEXT|> <|endoftext|>, é ́x naïve.́ '’s", "ǅabc ﬁn ʼn ß SS ẞ!? a.b, x;", ""]
    ids, ends = repair.Encoder(queries.tokenizer_path()).encode(pa.array(texts), 2)
    for a, b, x in zip(np.r_[0, ends], ends, texts):
        assert ids[a:b].tolist() == t.encode(x, add_special_tokens=False).ids + [2]


def test_encoder_in_all_scripts():
    """Words of letters, marks and punctuation of every script, those that NFC takes apart among them, have the library's ids."""
    import random
    import unicodedata

    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(queries.tokenizer_path()), random.Random(3)
    by = collections.defaultdict(list)
    for i in range(0x20, 0x30000):
        c = chr(i)
        if unicodedata.category(c)[0] not in "C":
            by[unicodedata.name(c, "?").split()[0]].append(c)
    torn = [chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.normalize("NFC", chr(i)) != chr(i)]
    scripts = sorted(by)
    texts = []
    for _ in range(20_000):
        pool = by[r.choice(scripts)]
        words_ = ["".join(r.choice(torn if r.random() < 0.1 else pool) for _ in range(r.randint(1, 5))) + "".join(r.choice(".,!?;:'\u0301") for _ in range(r.randint(0, 2))) for _ in range(r.randint(1, 4))]
        texts.append(r.choice([" ", "\n", "\t "]).join(words_))
    texts += ["\u095c.", "\u095d!", "\ufb2a,", "AL\u0130.", "\u1100\u1161."]
    ids, ends = repair.Encoder(queries.tokenizer_path()).encode(pa.array(texts), 2)
    wrong = [x for a, b, x, e in zip(np.r_[0, ends], ends, texts, t.encode_batch(texts, add_special_tokens=False)) if ids[a:b].tolist() != e.ids + [2]]
    assert not wrong


def test_encoder_of_another_file():
    """A file with another pre-tokenizer is never cut into words."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(path), ["two  spaces, it's\n\nx ", None, "", "é́ ok"]
    e = repair.Encoder(path)
    ids, ends = e.encode(pa.array(texts), 2)
    assert not e.by_word
    for a, b, x in zip(np.r_[0, ends], ends, texts):
        assert ids[a:b].tolist() == t.encode(x or "", add_special_tokens=False).ids + [2]


def brute_substring(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a : a + 13]), i) != i:
                gone[a : a + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, docs, odd, monkeypatch):
    for d, size in ((docs, 8 << 20), (docs, 20_000), (odd, 1)):
        monkeypatch.setattr(substring, "CHUNK_BYTES", size)
        got = sorted((tuple(r) for r in substring.deduplicated(d, batches=4).collect()), key=repr)
        assert got == brute_substring([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_substring_index_is_kept(spark, docs, tmp_path, monkeypatch):
    """Batches judged against a saved index give what one call on all of them gives; doc_ids of later ones are larger here."""
    monkeypatch.setattr(substring, "CHUNK_BYTES", 50_000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    got, folder = [], f"file://{tmp_path}/index"
    for part in (rows[:90], rows[90:91], [], rows[91:]):
        d = spark.createDataFrame(part, "doc_id long, text string")
        got += [tuple(r) for r in substring.deduplicated(d, batches=2, folder=folder).collect()]
    assert sorted(got, key=repr) == brute_substring(rows)
    again = substring.deduplicated(spark.createDataFrame([(-1, rows[5][1])], "doc_id long, text string"), folder=folder).collect()[0]
    assert again["n_removed"] == again["n_words"] or again["n_words"] < 13
    with pytest.raises(ValueError):
        substring.FingerprintIndex.open(spark, folder, 4, window=9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillmere")]


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(900, "u", "y" * 200), (901, None, "y" * 200), (902, "u", "z" * 99), (903, "u", "z" * 99), (904, "u", None), (905, "u", ""), (906, "u v\r\n", "é" * 80), (907, "u", "é" * 80), (900, "u", "y" * 200)], pages.schema)
    pages = pages.unionByName(more)
    pages = pages.withColumns({c: F.lit("own") for c in ("digest", "first", "refers_to", "path")})
    got = sorted((tuple(r) for r in warc.archived(spark, pages).collect()), key=repr)
    rows = sorted(tuple(r) for r in pages.select("page_id", F.coalesce("html", F.lit(""))).collect())
    first, want = {}, []
    for i, h in rows:
        b = h.encode()
        to = first.setdefault(b, i) if len(b) >= 100 else i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    assert got == sorted(want, key=repr)


def test_warc_odd_ids(spark):
    """Empty ids, ids with white space or percent signs, and null ones come back as they were."""
    pages = spark.createDataFrame([("", "u", "x" * 100), ("a b\r\n%41", "http://x/ y", "x" * 100), (None, "u", "x" * 100), ("é", None, "z")], "page_id string, url string, html string")
    got = sorted((r["page_id"] is None, r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(spark, pages).where("page_id is not null").collect())
    assert got == [(False, "", "response", None), (False, "a b\r\n%41", "revisit", ""), (False, "é", "response", None)]
    r = warc.archived(spark, pages).where("page_id is null").first()
    assert r["record_type"] == "revisit" and r["refers_to"] == "" and r["payload_bytes"] == 100


def test_warc_survives_a_task_run_again(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pages = spark.createDataFrame([(str(i), "u", "x" * i, "d", None) for i in range(20)], "page_id string, url string, html string, digest string, refers_to string")
    archives = warc.materialize(warc.write_monolithic(pages, folder), "archives")
    kept = [sorted(tuple(r) for r in warc.normalise(archives, folder).select("page_id", "length").collect()) for _ in range(2)]
    assert kept[0] == kept[1] and len(kept[0]) == 20
    whole = tmp_path / "whole"
    assert warc.archive(spark, pages.select("page_id", "url", "html"), f"file://{whole}").count() == 20
    assert not list(whole.glob("*.mono.warc.gz")) and list(whole.glob("*.warc.gz"))


def test_warc_stream_in_any_pieces():
    import io

    data = [warc.record(str(i), "u", b"\r\n\r\nContent-Length: 9" * i, "d", None) for i in range(20)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    mono = z.compress(b"".join(data)) + z.flush()
    for n in (1, 7, 1000):
        cut, out = warc.Records(), []
        for piece in warc.inflate(io.BytesIO(mono)):
            for a in range(0, len(piece), n):
                out += list(cut.feed(piece[a : a + n]))
        assert out == data


def brute_topk(rows, queries, k):
    """rows, queries: (vec_id, embedding). Every row but those with the query's vec_id; queries of one vec_id share k results."""
    fine = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    top, found = 2**63 - 1, collections.defaultdict(list)
    for q, a in fine:
        if q in queries:
            found[q] += [(-max(-top, min(top, sum(x * y for x, y in zip(a, e)))), i) for i, e in fine if i != q]
    return sorted((q, at, i, -s) for q, some in found.items() for at, (s, i) in enumerate(sorted(some)[:k], 1))


def test_vafile(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(1000, None), (1050, [float("nan")] * 64), (1100, [float("inf")]), (1150, [None, 1.0]), (1200, []), (1250, [0.5] * 3), (1250, [0.5] * 3), (1250, [0.25] * 3), (1300, [1e30, 1.0]), (0, None), (3, [0.5] * 64), (3, [0.5] * 64)], "vec_id long, embedding array<float>")
    for data, k in ((v, 5), (v.unionByName(bad), 5), (v.limit(3), 5)):
        data = data.withColumns({c: F.lit("own") for c in ("place", "asked", "upper", "score", "rank", "query_id")})
        got = vafile.topk(data, data.where("vec_id % 50 = 0"), k).collect()
        rows = [(r["vec_id"], r["embedding"]) for r in data.collect()]
        assert sorted(map(tuple, got)) == brute_topk(rows, {i for i, _ in rows if i % 50 == 0}, k)


def test_vafile_keeps_repeated_vec_ids(spark, tmp_path, duck):
    """As the registered SQL has it: of rows with one vec_id each is a result."""
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (2, [0.9, 0.0]), (50, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op6_vafile(spark, str(tmp_path)).collect()))
    cut = lambda e: [math.floor(256 * float(np.float32(x))) for x in e]
    assert got == [(50, 1, 1, 65536), (50, 2, 2, 256 * cut([0.9])[0]), (50, 3, 2, 32768), (50, 4, 2, 32768)]
    own = duck.cursor()
    own.execute(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(own.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op6_vafile']})").fetchall()) == got


def test_vafile_reads_few_exact_vectors(spark):
    """Of the given vectors, and of some made to prune, few pairs are read, and what is read holds the results."""
    made = [(i, [float(x) for x in np.random.default_rng(i).normal(0, 0.01 if i % 100 else 1.0, 8)]) for i in range(3000)]
    for data, ids, share in ((spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(4), (0, 100), 0.01), (spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding"), (0, 50, 100, 150), 0.05)):
        clean = vafile.materialize(vafile.usable(data), "vectors")
        file = vafile.materialize(vafile.approximated(clean), "va_file")
        assert "embedding" not in file.columns
        asked = clean.where(F.col("vec_id").isin(*ids)).toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(asked["vec_id"], dtype=np.int64), vafile.matrix(asked["embedding"])))
        pairs = vafile.materialize(vafile.reached(file, sent, spark.sparkContext.broadcast(vafile.floors(file, sent, 5))), "reached")
        read = vafile.certain(pairs, clean, sent, 5)
        n = clean.count()
        assert 5 * len(ids) <= read.count() <= pairs.count() <= share * n * len(ids)
        want = brute_topk([(r["vec_id"], r["embedding"]) for r in data.collect()], set(ids), 5)
        assert {(q, i, s) for q, _, i, s in want} <= {(r["query_id"], r["vec_id"], r["score"]) for r in read.collect()}


def test_ctw_is_a_distribution(spark, docs):
    """After any context, seen or not, the 256 bytes' probabilities sum to one; a tree of one node is plain KT."""
    text = b"abracadabra " * 20
    g, _ = ctw.codes(pa.array([text.decode()]))
    key, n = np.unique(g, return_counts=True)
    upper = ctw_upper(key, n.astype(float))
    for context in (b"cadab", b"zzzzz", b"\n\n\n\n\n"):
        base = int.from_bytes(context, "big") << 8
        more = np.array([base | x for x in range(256)], np.uint64)
        all_ = np.unique(np.r_[key, more])
        count = np.zeros(len(all_))
        count[np.searchsorted(all_, key)] = n
        p = 10 ** ctw.log_scores(all_, count, upper)
        assert abs(p[np.searchsorted(all_, more)].sum() - 1) < 1e-9


def tree_by_recursion(key, n):
    """log10 scores of any gram by a plain recursive tree over grams with counts: Krichevsky-Trofimov estimates of all depths mixed
    by halves; where the child on the path never occurred, the node's own estimate stands for it."""
    counts = collections.defaultdict(lambda: [0, 0])
    below = collections.defaultdict(set)
    known: dict = {}
    for k, times in zip(key.tolist(), n.tolist()):
        data = k.to_bytes(ctw.DEPTH + 1, "big")
        context, x = data[:-1], data[-1]
        for place in range(8):
            before, bit = (1 << place) | (x >> (8 - place)), x >> (7 - place) & 1
            for depth in range(ctw.DEPTH + 1):
                counts[context[ctw.DEPTH - depth :], before][bit] += times
                if depth:
                    below[context[ctw.DEPTH - depth + 1 :], before].add(context[ctw.DEPTH - depth :])

    def own(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def whole(node):
        context, before = node
        if len(context) == ctw.DEPTH:
            return own(node)
        if node not in known:
            known[node] = np.logaddexp(own(node) - math.log(2), sum(whole((c, before)) for c in below[node]) - math.log(2))
        return known[node]

    def one(context, before, depth=0):
        node = (context[ctw.DEPTH - depth :], before)
        a, b = counts[node]
        mine = (b + 0.5) / (a + b + 1)
        if depth == ctw.DEPTH or context[ctw.DEPTH - depth - 1 :] not in below[node]:
            return mine
        share = math.exp(own(node) - math.log(2) - whole(node))
        return share * mine + (1 - share) * one(context, before, depth + 1)

    def score(k):
        data = k.to_bytes(ctw.DEPTH + 1, "big")
        out = 0.0
        for place in range(8):
            p = one(data[:-1], (1 << place) | (data[-1] >> (8 - place)))
            out += math.log10(p if data[-1] >> (7 - place) & 1 else 1 - p)
        return out

    return score


def test_ctw_equals_a_tree_by_recursion(spark):
    text = b"banana bandana cabana " * 4
    g, _ = ctw.codes(pa.array([text.decode()]))
    key, n = np.unique(g, return_counts=True)
    got = ctw.log_scores(key, n.astype(float), ctw_upper(key, n.astype(float)))
    tree = tree_by_recursion(key, n)
    for k, score in zip(key.tolist(), got):
        assert abs(score - tree(k)) < 1e-8


def test_ctw_scores_equal_a_tree(spark, docs, odd):
    """The query's score, of texts that were learned and of held-out ones, whose contexts the tree may lack; odd rows too."""
    cut = lambda d, n: d.select("doc_id", F.left("text", F.lit(n)).alias("text"))
    d = cut(docs.orderBy("doc_id").limit(40), 250).unionByName(cut(odd, 120)).unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(["zq\x7f\u2603 new", "", "a"])], "doc_id long, text string"))
    fold = F.col("doc_id").isNotNull() & ((F.col("doc_id") % 5 == 0) | (F.col("doc_id") >= 10_000))
    rows = [(i, t, i is not None and (i % 5 == 0 or i >= 10_000)) for i, t in d.collect()]
    key, n = np.unique(np.concatenate([ctw.codes(pa.array([t], pa.string()))[0] for _, t, held in rows if not held]), return_counts=True)
    tree, want = tree_by_recursion(key, n), []
    for i, t, held in rows:
        want.append((repr(i), held, sum(tree(k) for k in ctw.codes(pa.array([t], pa.string()))[0].tolist())))
    got = sorted((repr(r["doc_id"]), r["held_out"], r["score"]) for r in ctw.scores(d, fold).collect())
    assert sum(h for _, h, _ in got) > 8
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-5, abs_tol=1e-4)


def ctw_upper(key, n):
    node, n0, n1, below = [], [], [], []
    for place in range(8):
        top = ctw.levels(key, n, place, 2)[-1]
        node.append((top.key & np.uint64(0xFFFF)).astype(np.int64)), n0.append(top.n0), n1.append(top.n1), below.append(top.log)
    node, n0, n1, below = map(np.concatenate, (node, n0, n1, below))
    out = []
    for size in (1 << 16, 1 << 8):
        i = node & (size - 1)
        n0, n1, below = (np.bincount(i, x, size) for x in (n0, n1, below))
        node = np.arange(size)
        whole, own = ctw.weighed(n0, n1, below)
        out.append((own, (n1 + 0.5) / (n0 + n1 + 1.0), n0 + n1 > 0))
        below = whole
    return out


def test_ctw(spark, docs, odd, monkeypatch):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    for d in (docs, odd):
        got = sorted((tuple(r) for r in ctw.scores(d, fold).drop("bits_per_byte").collect()), key=repr)
        rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
        held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
        c, ends = collections.Counter(), 0
        for i, t in rows:
            if not held[i]:
                c.update(words(lowered(t)))
                ends += 1
        total, v = sum(c.values()) + ends, len(c) + 1
        want = sorted(((i, held[i], len(words(t)) + 1, sum(c[w] > 0 for w in words(lowered(t))) + 1, total, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in words(lowered(t))) + math.log10((ends + 0.1) / (total + 0.1 * (v + 1)))) for i, t in rows), key=repr)
        for g, w in zip(got, want):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] < 0
        monkeypatch.setattr(ctw, "ENTRIES", 5000)  # several buckets, each dealt to several tasks
        monkeypatch.setattr(ctw, "ASKED", 20_000)
        again = sorted((tuple(r) for r in ctw.scores(d, fold).drop("bits_per_byte").collect()), key=repr)
        monkeypatch.undo()
        for a, b in zip(got, again):
            assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-6)
    learned = ctw.scores(docs, fold).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert learned[0] / learned[1] > -6  # far better than even odds over bytes


def test_ctw_texts_longer_than_a_chunk(spark):
    """A text of more bytes than a chunk is one of its own; other columns and an empty table don't matter."""
    long_ = "one two three four " * 250_000
    d = spark.createDataFrame([(1, long_, 5), (2, "one two", 6), (3, None, 7)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in ctw.scores(d, F.col("doc_id") == 2).collect()}
    assert [got[i]["n_tokens"] for i in (1, 2, 3)] == [1_000_001, 3, 1] and all(r["n_known"] == r["n_tokens"] for r in got.values())
    assert 0 < got[1]["bits_per_byte"] < 0.01 < got[3]["bits_per_byte"]  # four words in turn cost next to nothing
    assert math.isclose(got[1]["bits_per_byte"], -got[1]["score"] * math.log2(10) / (len(long_.strip()) + 1), rel_tol=1e-9)
    empty = ctw.scores(d.limit(0), F.lit(False))
    assert empty.count() == 0 and empty.columns == ctw.scores(d.where("doc_id > 1"), F.lit(False)).columns


def test_toxicity(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.clean(odd, labels).columns == odd.columns


def test_toxicity_held_out(spark):
    """On rows that nothing was learnt from."""
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    j = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id")
    for rows in (j.where("held_out"), j):
        r = rows.agg(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 0)), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.sum("toxic")).first()
        assert r[0] <= 3 and r[1] >= 0.6 * r[2]


def test_toxicity_risk():
    """The slope is the derivative of the risk, and where the unlabelled term is negative, that of its negative."""
    r = np.random.default_rng(0)

    def parts(g, y, prior):
        l = lambda x: math.log1p(math.exp(-x))
        p, u = [x for x, t in zip(g, y) if t], [x for x, t in zip(g, y) if not t]
        return prior * sum(map(l, p)) / len(p), sum(l(-x) for x in u) / len(u) - prior * sum(l(-x) for x in p) / len(p)

    seen = set()
    for case in range(20):
        g, y, prior = r.normal(0, 2, 12) + (case % 2) * np.r_[np.full(4, 4.0), np.full(8, -4.0)], np.arange(12) < 4, 0.3 + 0.6 * (case % 2)
        one, rest = parts(g, y, prior)
        value, slope = toxicity.risk(g, y, prior)
        assert math.isclose(value, one + max(0.0, rest), rel_tol=1e-9)
        seen.add(rest >= 0)
        for i in range(12):
            h = np.zeros(12)
            h[i] = 1e-6
            (a1, r1), (a0, r0) = parts(g + h, y, prior), parts(g - h, y, prior)
            want = (a1 + r1 - a0 - r0) / 2e-6 if rest >= 0 else -(r1 - r0) / 2e-6
            assert abs(slope[i] - want) < 1e-6
    assert seen == {True, False}


def test_toxicity_scores(spark, docs, odd):
    """Every row's score is that of the model on its whole text, feature by feature."""
    import xxhash

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    w, b = model[0].astype(np.float32), model[1]
    for d in (docs, odd):
        got = sorted((tuple(r) for r in toxicity.scored(d, model).collect()), key=repr)
        want = []
        for i, t in (tuple(r) for r in d.select("doc_id", "text").collect()):
            stripped = {x.strip(toxicity.PUNCTUATION) for x in words(lowered(t))}
            f = {xxhash.xxh3_64_intdigest(x, 0) % toxicity.FEATURES for x in stripped} | {xxhash.xxh3_64_intdigest(x[: toxicity.STEM], 1) % toxicity.FEATURES for x in stripped}
            want.append((i, 1 / (1 + math.exp(-(sum(float(w[x]) for x in f) + b)))))
        for x, y in zip(got, sorted(want, key=lambda r: (repr(r[0]), r[1]))):
            assert x[0] == y[0]
        assert np.allclose(sorted(x[1] for x in got), sorted(y[1] for y in want), atol=1e-6)


def test_toxicity_learns_from_unlabelled_text(spark):
    """The prior is found without a negative label, labels of 0 change nothing, and fold 0 teaches nothing."""
    r = np.random.default_rng(5)
    toxic = [bool(x) for x in r.random(1500) < 0.2]
    text = lambda t: " ".join([f"w{x}" for x in r.integers(0, 300, 20)] + [f"vile{x}" for x in r.integers(0, 5, 3)] * t)
    rows = [(i, text(t)) for i, t in enumerate(toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    confirmed = [(i, 1) for i in range(1500) if toxic[i] and i % 3 == 0]
    known = set(confirmed)
    p, u = [t for i, t in rows if (i, 1) in known], [t for i, t in rows if (i, 1) not in known]
    count = lambda ts: np.bincount(toxicity.features(pa.array(ts))[1], minlength=toxicity.FEATURES).astype(float)
    assert abs(toxicity.share(count(p), count(u), len(p), len(u)) - sum("vile" in t for t in u) / len(u)) < 0.05
    labels = spark.createDataFrame(confirmed, "doc_id long, toxic int")
    got = sorted(tuple(x) for x in toxicity.toxicity(docs, labels).collect())
    assert sum((x[3] == 1) == toxic[x[0]] for x in got) >= 0.97 * 1500
    more = labels.unionByName(spark.createDataFrame([(i, 0) for i in range(0, 1500, 2) if not toxic[i]] + [(i, 1) for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, toxic int"))
    assert sorted(tuple(x) for x in toxicity.toxicity(docs, more).collect()) == got


def brute_jaccard(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(lowered(t))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def family(n, seed=0):
    """Texts that differ in a few words from one another, chained so that not all of them link."""
    r = np.random.default_rng(seed)
    base = [f"w{x}" for x in r.integers(0, 500, 120)]
    out = []
    for i in range(n):
        t = list(base)
        for at in r.integers(0, 120, r.integers(0, 5)):
            t[at] = f"n{i}x{at}"
        out.append((i * 3 + seed, " ".join(t)))
        base = t if i % 9 == 0 else base
    return out


@pytest.mark.parametrize(("k", "percent", "size"), [(3, 90, 128), (5, 80, 4)])
def test_jaccard(spark, docs, k, percent, size, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", size)
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 10_000, t) for i, t in family(60) + family(30, 1)], "doc_id long, text string"))
    got = sorted(tuple(r) for r in jaccard.joined(d, k, percent).collect())
    assert got == brute_jaccard([tuple(r) for r in d.collect()], k, percent)


def test_jaccard_odd(spark, odd):
    got = sorted((tuple(r) for r in jaccard.joined(odd, 3, 90).collect()), key=repr)
    known = [r for r in got if r[0] is not None]
    want = dict((r[0], r) for r in brute_jaccard([tuple(r) for r in odd.select("doc_id", "text").where("doc_id is not null").collect()], 3, 90))
    assert len(got) == odd.count() and all(r == want[r[0]] for r in known)
    kept = jaccard.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 6").count() == 0


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/1?x#y", "http://www.example.com/en/", "https://a.net/es/x", "https://net/fr/", "http://x.org", "http://x.org?q=/en/", "http://notcom/", "http://eÉ.ORG/#/a", "://com/", "http://bad.org/1"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(12, "http://bad.org/1")], "page_id long, url string").withColumn("rule", F.lit("own"))
    bad = spark.createDataFrame([(12, 1), (12, 0), (None, 1)], "page_id long, bad int")
    got = {(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filtered(pages, bad).collect()}
    assert url_filter.filtered(pages, bad).count() == 14
    assert got[0] == ("", "", None, "allow") == got[1] == got[2]
    assert got[3] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[4][2:] == ("www.example.com/en/", "allow")
    assert got[5][2:] == ("net/es/", "block") and got[6][2:] == ("net/fr/", "block") and got[7] == ("x.org", "", None, "allow")
    assert got[8][:2] == ("x.org", "") and got[9][2] is None and got[10][:2] == ("eÉ.org", "/") and got[11][2:] == ("com/", "allow")


def test_url_reputation(spark):
    host = lambda i: "bad.org" if i < 40 else f"h{i % 5}.good.org"
    pages = spark.createDataFrame([(i, f"http://{host(i)}/{i}") for i in range(200)], "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 200, 2)], "page_id long, bad int")
    got = {r["host"]: r["verdict"] for r in url_filter.filtered(pages, bad).collect()}
    assert got.pop("bad.org") == "block" and set(got.values()) == {"allow"}


@pytest.mark.parametrize("zips", [0, 60])
def test_url_reputation_without_labels(spark, zips):
    """Hosts without a label are allowed under a suffix of good and bad domains, and where one bad host is all that is known of it;
    they are blocked where many bad domains leave no doubt. Very long urls, ports and addresses are judged like others."""
    hosts = [f"d{i % 10}.org" for i in range(200)] + ["bad.info"] * 20 * (not zips) + [f"d{i}.zip" for i in range(zips)]
    new = {"clean.org": "allow", "never.org:8080": "allow", "10.0.0.1": "allow", "x.org/" + "y" * 200_000: "allow"} | ({"clean.zip": "block"} if zips else {"clean.info": "allow"})
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate([*hosts, *new])], "page_id long, url string")
    bad = spark.createDataFrame([(i, int(h in ("d1.org", "d2.org", "bad.info") or h.endswith(".zip"))) for i, h in enumerate(hosts)], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filtered(pages, bad).collect()}
    assert [got[len(hosts) + i] for i in range(len(new))] == list(new.values())
    assert got[1] == "block" and got[len(hosts) - 1] == "block" and got[0] == "allow"


def test_url_strength(spark):
    """Twenty hosts of forty outcomes each whose rates are 0.1 or 0.9: strength near p (1 - p) / variance - 1 = 0.25 / 0.16 - 1."""
    units = spark.createDataFrame([("g", 40.0, 4.0 if i % 2 else 36.0) for i in range(20)], "g string, n double, x double")
    assert url_filter.strength(units, ["g"], "k").first()[0] == url_filter.WEAKEST
    units = spark.createDataFrame([("g", 40.0, 16.0 if i % 2 else 24.0) for i in range(20)], "g string, n double, x double")
    k = url_filter.strength(units, ["g"], "k").first()[0]
    s, w, free, more = 20 * 40 * 0.1**2, 0.25, 19, 800 - 40 - 19
    assert math.isclose(k, w / ((s - w * free) / more) - 1)
    assert url_filter.strength(units.limit(1), ["g"], "k").first()[0] == url_filter.UNKNOWN


def test_url_domains(spark):
    want = {
        "x.spam.co.uk": ("spam.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.example.com": ("example.com", "com"), "net": ("net", "net"), "": ("", ""), "a.b.nowhere": ("b.nowhere", "nowhere"),
        "10.0.0.1": ("10.0.0.1", "[ip]"), "10.0.0.1:80": ("10.0.0.1", "[ip]"), "[2001:db8::1]:8080": ("[2001:db8::1]", "[ip]"), "u:p@www.shop.com.au:443": ("shop.com.au", "com.au"), "www.x.co.jp.": ("x.co.jp", "co.jp"),
        "a.b.c.ck": ("b.c.ck", "c.ck"), "a.www.ck": ("www.ck", "ck"), "a.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp"), "a.b.other.kawasaki.jp": ("b.other.kawasaki.jp", "other.kawasaki.jp"), "kawasaki.jp": ("kawasaki.jp", "jp"),
        "w.x.公司.cn": ("x.公司.cn", "公司.cn"), "w.x.xn--55qx5d.cn": ("x.xn--55qx5d.cn", "xn--55qx5d.cn"),
    }
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_domain(spark.createDataFrame([(h,) for h in want], "host string")).collect()}
    assert got == want


@pytest.mark.parametrize("port", ["", ":8080"])
def test_url_reputation_under_long_suffixes(spark, port):
    urls = [f"http://h{i}.spam.co.uk/" for i in range(40)] + [f"http://h{i}.good{i}.co.uk{port}/" for i in range(400)] + ["http://x.spam.co.uk/", "http://x.good1.co.uk/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i < 40)) for i in range(440)], "page_id long, bad int")
    got = {r["host"]: r["verdict"] for r in url_filter.filtered(pages, bad).collect()}
    assert len(got) == 442 and got["x.spam.co.uk"] == "block" and got["x.good1.co.uk"] == "allow"


def test_sql(spark, duck):
    from helpers import rows_of

    for name, sql in queries.ORACLES.items():
        cols, got = rows_of(queries.QUERIES[name](spark, SF))
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        at = [names.index(c) for c in cols]
        assert got == sorted((tuple(round(x[i], 6) if isinstance(x[i], float) else x[i] for i in at) for x in r.fetchall()), key=repr), name
