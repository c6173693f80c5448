"""Queries over whole texts of any characters, against brute force."""

from helpers import SF
from pyspark.sql import functions as F

from quillmere.operators import chunking
from quillmere.plans.queries import QUERIES


def test_overlap_of_all_texts(spark):
    def want(rows):
        return sorted((i, n, chunking.tail(x, 50)) for i, t in rows for n, x in enumerate(["", *t.split("\n")[:-1]]))

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["chunk_overlap"](spark, SF).collect())
    assert got == want(rows) and {i for i, _, _ in got} == {i for i, _ in rows} and any(not t.isascii() for _, t in rows)
    odd = [(n, "a" * (n % 5) + c * n + "b" * (n % 3) + "\nlast") for c in ("é", "本", "😀", "x") for n in range(40, 205)] + [(0, ""), (1, "\n\n"), (1, "é\né")]
    docs = spark.createDataFrame(odd, "doc_id int, text string")
    assert sorted(tuple(r) for r in chunking.overlaps(docs, "doc_id", F.col("text")).collect()) == want(odd)


def test_csv_lines_hold_whole_values(spark, tmp_path):
    def cell(x):
        x = "" if x is None else str(x)
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x

    odd = spark.createDataFrame([(-1, "x" * 70 + ', "é"\n', None, "a,b", 3), (-2, None, "de", 'say "s"', None), (-3, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{SF}/documents.parquet").select(*odd.columns).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: ",".join(map(cell, r)) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = {r["doc_id"]: r["line"] for r in QUERIES["export_csv_lines"](spark, str(tmp_path)).collect()}
    assert got == want and max(map(len, got.values())) > 1000
