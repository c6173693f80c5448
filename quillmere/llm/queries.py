"""The registered queries of the training-data operators, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.mixing import mixture, quality_weights

    m = mixture(table(spark, sf_dir, "documents"), quality=quality_weights(table(spark, sf_dir, "labels")))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text_key")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.repair import written

    return written(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.substring import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.warc import archived

    return archived(spark, table(spark, sf_dir, "pages"))


def op6_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.vafile import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.ctw import scores

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return scores(table(spark, sf_dir, "documents"), fold == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.jaccard import joined

    return joined(table(spark, sf_dir, "documents"), 3, 90)


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.url_filter import filtered

    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return filtered(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmere.llm.packing import packed

    found = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.variants import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_decontaminate, op3_repair, op4_substring, op5_warc, op6_vafile, op7_ctw, op8_toxicity, op9_jaccard, op10_url_reputation, op11_divergence, op12_packing, op13_variants)}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all(coalesce({}, ''), '[^ \t\n\x0b\f\r]+')"

#: DuckDB SQL of the queries that it can express. op3, op7, op8, op9, op12 and the pipeline have none: tokenizers, trees and a
#: classifier that learn, and components over a similarity join are held against brute force in tests/llm.
ORACLES = {
    "op1_mixing": rf"""WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) w FROM labels GROUP BY 1),
d AS (SELECT d.doc_id, d.source, len({SPACED.format("text")})::BIGINT size, -ln((('0x' || left(md5(d.doc_id || ':17'), 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / coalesce(q.w, 1.0)::DOUBLE AS key FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::DOUBLE source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE w FROM d GROUP BY 1),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(2 * source_size, w * coalesce((SELECT max(lev) FROM l WHERE lev * w <= 2 * source_size), 'inf'::DOUBLE)) target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) begins FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size::BIGINT source_size, target, ((epochs + CASE WHEN budget > 0 AND begins + size / 2 <= budget THEN 1 ELSE 0 END) * size)::BIGINT taken FROM p""",
    "op2_decontaminate": rf"""WITH i AS (SELECT item_id, {BENCH.format(LOWER.format("text"))} ws FROM benchmark),
w AS (SELECT DISTINCT item_id, ws[a:a + 12] w, len(ws[a:a + 12]) n FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) a FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({BENCH.format(LOWER.format("text"))}, []) ws FROM documents),
m AS (SELECT p.doc_id, w.item_id, p.a, w.n FROM (SELECT doc_id, n, a, ws[a:a + n - 1] x FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) a FROM d, (SELECT DISTINCT n FROM w) k WHERE len(ws) >= n)) p JOIN w ON p.n = w.n AND p.x = w.w),
h AS (SELECT doc_id, count(DISTINCT pos) n_hit FROM (SELECT doc_id, unnest(generate_series(a, a + n - 1)) AS pos FROM m) GROUP BY 1),
g AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op4_substring": rf"""WITH d AS (SELECT doc_id, {SPACED.format("text")} ws FROM documents),
w AS (SELECT doc_id, a, ws[a:a + 12] x FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) a FROM d WHERE len(ws) >= 13)),
r AS (SELECT doc_id, a, min(doc_id) OVER (PARTITION BY x) f FROM w),
g AS (SELECT doc_id, list(DISTINCT pos) gone FROM (SELECT doc_id, unnest(generate_series(a, a + 12)) AS pos FROM r WHERE f < doc_id) GROUP BY 1),
u AS (SELECT doc_id, unnest(ws) x, generate_subscripts(ws, 1) AS pos FROM d),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.pos) kept FROM u LEFT JOIN (SELECT doc_id, unnest(gone) AS pos FROM g) z ON u.doc_id = z.doc_id AND u.pos = z.pos WHERE z.pos IS NULL GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT n_words, coalesce(len(gone), 0)::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), f AS (SELECT h, min(page_id) f FROM p WHERE strlen(h) >= 100 GROUP BY 1)
SELECT page_id, strlen(p.h) payload_bytes, sha256(p.h) payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END record_type, CASE WHEN f < page_id THEN f END refers_to FROM p LEFT JOIN f ON p.h = f.h""",
    "op6_vafile": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT score FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_url_reputation": rf"""WITH o AS (SELECT doc_id page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) bad FROM labels GROUP BY 1),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM pages),
p AS (SELECT page_id, {LOWER.format("regexp_extract(r, '^[^/?#]*')")} host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM a),
n AS (SELECT *, CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] END dom, string_split(host, '.')[-1] suf FROM p),
h AS (SELECT host, dom, suf, count(bad)::DOUBLE n, coalesce(sum(bad), 0)::DOUBLE x FROM n LEFT JOIN o USING (page_id) GROUP BY host, dom, suf),
kh AS (SELECT CASE WHEN w > 1e-9 AND more > 1e-9 THEN CASE WHEN beyond <= w / 10001 THEN 10000 ELSE greatest(w / beyond - 1, 2) END ELSE 2 END::DOUBLE k FROM (SELECT w, more, (s - w * free) / more beyond FROM (SELECT sum(xx - x * x / n) s, sum(x - x * x / n) / sum(n) w, sum(n - nn / n) - sum(k - 1) more, sum(k - 1)::DOUBLE free
FROM (SELECT sum(n) n, sum(x) x, sum(n * n) nn, sum(x * x / n) xx, count(*) k FROM h WHERE n > 0 GROUP BY suf, dom)))),
dm AS (SELECT suf, dom, coalesce(sum(CASE WHEN n > 0 THEN n * (k + 1) / (n + k) END), 0) n, coalesce(sum(CASE WHEN n > 0 THEN (k + 1) / (n + k) * x END), 0) x FROM h, kh GROUP BY suf, dom),
kd AS (SELECT CASE WHEN w > 1e-9 AND more > 1e-9 THEN CASE WHEN beyond <= w / 10001 THEN 10000 ELSE greatest(w / beyond - 1, 2) END ELSE 2 END::DOUBLE k FROM (SELECT w, more, (s - w * free) / more beyond FROM (SELECT sum(xx - x * x / n) s, sum(x - x * x / n) / sum(n) w, sum(n - nn / n) - sum(k - 1) more, sum(k - 1)::DOUBLE free
FROM (SELECT sum(n) n, sum(x) x, sum(n * n) nn, sum(x * x / n) xx, count(*) k FROM dm WHERE n > 0 GROUP BY suf)))),
sf AS (SELECT suf, coalesce(sum(CASE WHEN n > 0 THEN n * (k + 1) / (n + k) END), 0) n, coalesce(sum(CASE WHEN n > 0 THEN (k + 1) / (n + k) * x END), 0) x FROM dm, kd GROUP BY suf),
ks AS (SELECT CASE WHEN w > 1e-9 AND more > 1e-9 THEN CASE WHEN beyond <= w / 10001 THEN 10000 ELSE greatest(w / beyond - 1, 2) END ELSE 2 END::DOUBLE k FROM (SELECT w, more, (s - w * free) / more beyond FROM (SELECT sum(xx - x * x / n) s, sum(x - x * x / n) / sum(n) w, sum(n - nn / n) - sum(k - 1) more, sum(k - 1)::DOUBLE free
FROM (SELECT sum(n) n, sum(x) x, sum(n * n) nn, sum(x * x / n) xx, count(*) k FROM sf WHERE n > 0 HAVING count(*) > 0)))),
al AS (SELECT (x + 0.8::DOUBLE) / (n + 8) m, n FROM (SELECT coalesce(sum(CASE WHEN n > 0 THEN n * (k + 1) / (n + k) END), 0) n, coalesce(sum(CASE WHEN n > 0 THEN (k + 1) / (n + k) * x END), 0) x FROM sf, ks)),
ps AS (SELECT suf, mean, mean * (1 - mean) / (n + size + 1) var FROM (SELECT suf, n, size, (x + size * m) / (n + size) mean FROM (SELECT *, m * (1 - m) / ((m * (1 - m) - v) / (k + 1) + v) - 1 size FROM (SELECT sf.*, m, m * (1 - m) / (al.n + 9) v FROM sf, al), ks))),
pd AS (SELECT suf, dom, mean, mean * (1 - mean) / (n + size + 1) var FROM (SELECT suf, dom, n, size, (x + size * m) / (n + size) mean FROM (SELECT *, m * (1 - m) / ((m * (1 - m) - v) / (k + 1) + v) - 1 size FROM (SELECT dm.*, mean m, var v FROM dm JOIN ps USING (suf)), kd))),
ph AS (SELECT host, mean, mean * (1 - mean) / (n + size + 1) var FROM (SELECT host, n, size, (x + size * m) / (n + size) mean FROM (SELECT *, m * (1 - m) / ((m * (1 - m) - v) / (k + 1) + v) - 1 size FROM (SELECT h.host, h.n, h.x, mean m, var v FROM h JOIN pd USING (suf, dom)), kh))),
v AS (SELECT host, CASE WHEN mean - sqrt(var) > 0.25 THEN 'block' ELSE 'allow' END hv FROM ph),
c AS (SELECT page_id, host, path, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
SELECT page_id, c.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE hv END verdict FROM c JOIN v USING (host)""",
    "op11_divergence": r"""WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws FROM documents),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) term FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, source, term, n FROM (SELECT lang, source, term, count(*) n FROM (SELECT lang, source, unnest(ws) term FROM d) GROUP BY ALL) SEMI JOIN df USING (lang, term)),
g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT total, coalesce(terms, 0)::HUGEINT terms FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) terms FROM df GROUP BY ALL) USING (lang)),
w AS (SELECT lang, term, sum(n)::HUGEINT n, sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT total FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, df.term, coalesce(c.n, 0) n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.terms) p, 1 + 1000000000::HUGEINT * (w.n + 5) // (w.total + 5 * g.terms) q
FROM g JOIN df USING (lang) JOIN w USING (lang, term) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = df.term),
f AS (SELECT g.lang, g.source, h.source item, 'pair' part, coalesce(v, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
UNION ALL SELECT lang, source, term, 'term', (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_variants": r"""WITH RECURSIVE tab(t) AS (SELECT list(x ORDER BY b) FROM (SELECT b, list_reduce(list_transform(range(8), lambda i: b), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) x FROM (SELECT unnest(range(256)) b))),
r AS (SELECT doc_id, w, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)), lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1]), 4294967295), 4294967295) h FROM r, tab),
c AS (SELECT word, sum(n)::BIGINT n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END word FROM h) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
e AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) gone, left(word, i) || '*' || substr(word, i + 2) wild FROM (SELECT word, n, unnest(range(length(word))) i FROM c)),
p AS (SELECT a.word a, b.word b, b.n n FROM e a JOIN e b USING (wild) WHERE a.word <> b.word UNION SELECT e.word, c.word, c.n FROM e JOIN c ON gone = c.word UNION SELECT c.word, e.word, e.n FROM e JOIN c ON gone = c.word),
m AS (SELECT a word, count(*) n_near, first(b ORDER BY n DESC, b) form, max(n) form_n FROM p GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN form_n >= 5 * n THEN form END form, CASE WHEN form_n >= 5 * n THEN form_n END form_n FROM c LEFT JOIN m USING (word)),
w(word, root) AS (SELECT word, word FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON w.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT w.word, w.root FROM w JOIN f ON w.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)""",
}
