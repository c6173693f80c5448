"""The source audit against DuckDB SQL, a brute-force version, and odd rows."""

import collections
import re

from odd_rows import docs, odd  # noqa: F401
from pyspark.sql import functions as F

from quillmere.llm import divergence


def brute(rows, least, top=50):
    """rows: (text, lang, source). Every group by every kept term."""
    at = collections.defaultdict(collections.Counter)
    held = collections.defaultdict(collections.Counter)
    groups = collections.defaultdict(set)
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode().lower().decode())
        groups[lang or ""].add(source or "")
        at[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        total = {s: sum(at[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (at[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        n = {t: sum(at[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            far = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(far, 1)]
            above = sorted(((p[s][t] - q[t], t) for t in kept if at[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i) for i, (v, t) in enumerate(above[:top], 1)]
    return sorted(out)


def rows_of(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


def test_equals_brute_force(spark, docs, odd):
    for d, least, top in ((docs, 30, 50), (docs, 3, 7), (odd, 1, 50), (odd, 2, 1), (odd, 30, 50)):
        assert sorted(map(tuple, divergence.divergence(d, least, top).collect())) == brute(rows_of(d), least, top)


def test_groups_without_terms_and_ties(spark):
    """A source of empty texts, one that lacks every term of another, ties, two sources that both are empty strings."""
    rows = [("a a b", "x", "s"), ("A b é", "x", "t"), ("", "x", "u"), (None, "x", None), ("b", "x", ""), ("zz-zz", "y", "s"), ("b a", "x", "v"), ("1 2", "z", "s"), (None, None, None)]
    d = spark.createDataFrame([(*r, 1, 2, "g") for r in rows], "text string, lang string, source string, n int, value int, term string")
    for least in (1, 2, 3, 9):
        assert sorted(map(tuple, divergence.divergence(d, least).collect())) == brute(rows_of(d), least)


def test_counts_beyond_long_products(spark):
    """Shares of counts whose product with the scale no longer fits 64 bits."""
    n, total = 3 * 10**11, 10**12
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("total"), F.lit(7).alias("terms")).select(divergence.share("n", "total")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 35)
