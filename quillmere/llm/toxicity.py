"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier over hashed words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.common import binary_texts, byte_list, hashes, slices, split_words

#: Hashed features of the classifier.
FEATURES = 1 << 18
#: Bounds of the fit, by smallest digest of doc_id: confirmed toxic rows, rows taken as unlabelled text, and bytes of text of each.
POSITIVE, UNLABELLED, SAMPLE_BYTES = 4000, 8000, 64 << 20
STEPS, RATE, L1 = 150, 0.3, 1e-4
#: Standard deviations by which a feature must be commoner among confirmed rows to be learnt.
MARKED = 5.0
#: The prior is read from the ANCHORS best of the features that at least ANCHORED of the confirmed rows have.
ANCHORS, ANCHORED = 16, 0.1
#: Bytes of a word's stem.
STEM = 5
PUNCTUATION = b".,;:!?()[]{}\"'*#%&|-_"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's features start, the feature numbers, and the text of each: its distinct words, lower-cased and
    without punctuation at their ends, and their first STEM bytes. Null and empty texts have none but the bias."""
    codes, words, offsets = split_words(binary_texts(texts), True)
    stripped = [w.strip(PUNCTUATION) for w in byte_list(words)]
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    used = np.unique(doc * max(1, len(words)) + codes)
    doc, codes = used // max(1, len(words)), used % max(1, len(words))
    both = [(hashes(pa.array(x, pa.large_binary()), seed) % np.uint64(FEATURES)).astype(np.int64)[codes] for seed, x in enumerate((stripped, [w[:STEM] for w in stripped]))]
    pairs = np.unique(np.concatenate([doc * FEATURES + f for f in both]))
    of, f = pairs // FEATURES, pairs % FEATURES
    return np.searchsorted(of, np.arange(len(offsets))), f, of


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def risk(g: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores g with the logistic loss l, prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),
    where y tells confirmed rows (p) from unlabelled ones (u), and the slope that a step follows: where the second term is
    negative, its gradient is ascended instead."""
    n_p, n_u = max(1, int(y.sum())), max(1, int((~y).sum()))
    s, loss = sigmoid(g), np.logaddexp(0, g)
    rest = loss[~y].sum() / n_u - prior * loss[y].sum() / n_p
    slope = np.zeros(len(g))
    if rest >= 0:
        slope[~y] = s[~y] / n_u
        slope[y] = -prior / n_p  # of both terms that confirmed rows stand in: l(g) - l(-g) = -g
    else:
        slope[~y] = -s[~y] / n_u
        slope[y] = prior * s[y] / n_p
    return prior * np.logaddexp(0, -g[y]).sum() / n_p + max(0.0, rest), slope


def descend(f: np.ndarray, of: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch adaptive gradient steps on risk(), with an L1 step that keeps features of chance at
    nought."""
    n = len(y)
    w, b = np.zeros(FEATURES), -2.0
    v, v_b = np.full(FEATURES, 1e-16), 1e-16
    for _ in range(STEPS):
        _, slope = risk(np.bincount(of, w[f], n) + b, y, prior)
        grad, grad_b = np.bincount(f, slope[of], FEATURES), slope.sum()
        v, v_b = v + grad * grad, v_b + grad_b * grad_b
        rate = RATE / np.sqrt(v)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        b -= RATE * grad_b / np.sqrt(v_b)
    return w, b


def marked(confirmed: np.ndarray, unlabelled: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Which features, by how many of the n_p confirmed and n_u unlabelled rows have them, are commoner among the confirmed."""
    rate = (confirmed + unlabelled) / (n_p + n_u)
    apart = confirmed / n_p - unlabelled / n_u
    return (confirmed > 0) & (apart >= MARKED * np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u)))


def share(confirmed: np.ndarray, unlabelled: np.ndarray, n_p: int, n_u: int) -> float:
    """The class prior of the unlabelled rows, without a negative: where a feature is found in toxic rows alone, its rate among
    unlabelled rows is that among confirmed ones times the prior, elsewhere more. So of the features that many confirmed
    rows have, those of the least ratio (by the upper end of their chance) tell it; their median is taken."""
    some = confirmed >= max(1.0, ANCHORED * n_p)
    if not some.any():
        return 1 / n_u
    p, u = confirmed[some], unlabelled[some]
    best = np.argsort((u + 2 * np.sqrt(u) + 1) / p, kind="stable")[:ANCHORS]
    return float(np.clip(np.median(u[best] / n_u / (p[best] / n_p)), 1 / n_u, 0.9))


def fit(confirmed: list[pa.Array], unlabelled: list[pa.Array]) -> tuple[np.ndarray, float]:
    """Weights and bias from confirmed and unlabelled texts, by the features that mark the confirmed and a prior by share(). What
    is held of all texts is their features as 32-bit numbers, of which only the marking ones are put together."""
    held, sizes, counts = [], [0, 0], np.zeros((2, FEATURES))
    for kind, arrays in enumerate((confirmed, unlabelled)):
        for texts in arrays:
            for at, n in slices(texts):
                _, f, of = features(texts.slice(at, n))
                held.append((f.astype(np.int32), (of + sum(sizes)).astype(np.int32)))
                counts[kind] += np.bincount(f, minlength=FEATURES)
                sizes[kind] += n
    n_p, n_u = sizes[0], max(1, sizes[1])
    keep = marked(*counts, n_p, n_u)
    held = [(f[keep[f]], of[keep[f]]) for f, of in held]
    f, of = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    return descend(f, of, np.arange(sum(sizes)) < n_p, share(*counts, n_p, n_u))


def fold(col, parts: int):
    return F.crc32(col.cast("string").cast("binary")) % parts


def sample(docs: DataFrame, ids: DataFrame, most: int) -> list[pa.Array]:
    """Texts of the docs whose doc_id is one of the `most` of ids (s_id) with the smallest digests, in that order, as many as
    SAMPLE_BYTES hold, the first at least; of rows that share a doc_id, the smallest text."""
    picked = ids.distinct().orderBy(F.md5(F.col("s_id").cast("string")), "s_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("s_id"))  # picked: at most `most` rows
    rows = rows.groupBy("s_id").agg(F.min("text").alias("text")).withColumn("digest", F.md5(F.col("s_id").cast("string")))
    before = Window.orderBy("digest", "s_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of at most `most` rows
    sizes = rows.select("s_id", "digest", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sizes = sizes.withColumn("sum", F.sum("size").over(before)).where((F.col("sum") <= SAMPLE_BYTES) | (F.col("sum") == F.col("size"))).select("s_id")
    return rows.join(F.broadcast(sizes), "s_id").orderBy("digest", "s_id").select("text").toArrow()["text"].chunks


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED, folds: int = 5) -> tuple[np.ndarray, float]:
    """Fits on confirmed toxic rows and on unlabelled text, both of folds other than 0, up to `positive` and `unlabelled` rows and
    SAMPLE_BYTES of text each. A row is confirmed if its labels say toxic; all other documents are unlabelled, and no label
    that says otherwise is read. Without a confirmed row every text scores by a bias of -1."""
    known = labels.where((F.col("toxic") == 1) & (fold(F.col("doc_id"), folds) != 0)).select(F.col("doc_id").alias("s_id"))
    p = sample(docs, known, positive)
    if not sum(map(len, p)):
        return np.zeros(FEATURES), -1.0
    rest = docs.where(fold(F.col("doc_id"), folds) != 0).select(F.col("doc_id").alias("s_id")).join(known, "s_id", "left_anti")
    model = fit(p, sample(docs, rest, unlabelled))
    pa.default_memory_pool().release_unused()
    return model


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """A function of a batch of rows that gives the scores of its texts. What is broadcast is FEATURES numbers."""
    w, b = model
    sent = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), float(b)))

    def score(texts: pa.Array) -> np.ndarray:
        w, b = sent.value
        out = np.zeros(len(texts))
        for at, n in slices(texts):
            _, f, of = features(texts.slice(at, n))
            out[at : at + n] = sigmoid(np.bincount(of, w[f], n) + b)
        return out

    return score


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1), by the whole of each text alone; a null or empty text scores by the bias."""
    score = scorer(docs, model)

    def batch_scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")))], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(batch_scores, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of docs, columns unchanged, whose texts score below 0.5. Null and empty texts score by the bias; texts of any
    length are read whole; no docs give no rows, and no labels let all pass."""
    score = scorer(docs, train(docs, labels, **bounds))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); see train() for what is learnt.
    Labels, lang, source and doc_id are no inputs of a score. Repeated rows are scored each; empty tables give none."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, **bounds))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


