"""Conversion by tasks: attempts that die change nothing, tasks can run again, no text passes through the driver."""

import os

import pytest
from pyspark.sql import functions as F
from test_engine import put

from quillmere.engine import ConvertVault, CrawlVault
from quillmere.sources import extract


def files(spark, root, names):
    return spark.createDataFrame([(n, "md", os.path.join(root, n), "<!-- head -->\n") for n in names], "path string, ext string, full string, head string")


def test_tasks_that_run_twice(spark, tmp_path):
    root, stage = str(tmp_path), str(tmp_path / "stage")
    for n in ("a.md", "b.md"):
        put(root, n, f"text of {n}")
    plan = extract.staged(files(spark, root, ["a.md", "b.md", "none.md"]), stage)
    plan.collect()  # an attempt whose report is lost
    rows = {r["path"]: r for r in plan.collect()}
    assert rows["none.md"]["kind"] == "failed" and rows["none.md"]["staged"] is None and len(os.listdir(stage)) == 4
    moves = spark.createDataFrame([(p, r["staged"], f"{root}/out/{p}", r["out_hash"]) for p, r in rows.items() if r["staged"]], "path string, staged string, target string, out_hash string")
    for _ in range(2):  # the second time all is renamed
        assert extract.placed(moves).where("placed").count() == 2
    assert open(f"{root}/out/a.md").read() == "<!-- head -->\ntext of a.md" and sorted(os.listdir(f"{root}/out")) == ["a.md", "b.md"]
    put(root, "out/a.md", "of another run")
    assert [r["path"] for r in extract.placed(moves).where("NOT placed").collect()] == ["a.md"]


def test_a_run_that_dies(spark, tmp_path, monkeypatch):
    """Before files are renamed: outputs, registry and conflicts are as they were, and the next run goes through."""
    root = str(tmp_path)
    put(root, "a b.md", "# A\n\none")
    v = ConvertVault(spark, root, create=True)
    v.add()
    assert v.convert() == {"converted": 1}
    out = os.path.join(root, "converted/a b.md.md")
    was = open(out).read()
    assert was.startswith("<!-- md: source=a%20b.md hash=")
    put(root, "a b.md", "# A\n\ntwo")
    row = v.ls().collect()

    def dies(moves):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(extract, "placed", dies)
        with pytest.raises(RuntimeError, match="killed"):
            v.convert()
    assert open(out).read() == was and v.ls().collect() == row and not os.path.exists(out + ".new")
    assert v.convert() == {"converted": 1} and "two" in open(out).read() and v.convert() == {"skipped": 1}
    assert [tuple(r) for r in v.results().collect()] == [("a b.md", "skipped", None, "converted/a b.md.md")]
    assert v.show("converted/a b.md.md").first()["input_path"] == "a b.md" and set(v.check().values()) == {0}


def test_rows_of_a_run(spark, tmp_path):
    root = str(tmp_path)
    for n in ("good.md", "gone.md", "large.txt"):
        put(root, n, n * 3)
    v = ConvertVault(spark, root, create=True)
    v.add()
    os.remove(os.path.join(root, "gone.md"))
    v.store.set("convert.size_cap_bytes", 25)
    assert v.convert() == {"converted": 1, "missing": 1, "too_large": 1}
    assert [tuple(r) for r in v.results().collect()] == [("gone.md", "missing", None, None), ("good.md", "converted", None, "converted/good.md.md"), ("large.txt", "too_large", None, None)]
    rows = {r["input_path"]: r for r in v.ls().collect()}
    assert rows["gone.md"]["last_attempt"] is not None and rows["good.md"]["last_src_size"] == 21 and rows["good.md"]["last_src_mtime"] == int(os.path.getmtime(os.path.join(root, "good.md")) * 1000)
    i = v.info()
    assert (i["registered"], i["converted"], i["missing"], i["by_extractor"]) == (3, 1, 1, {"markdown": 1})
    assert v.prune("missing") == {"missing": 1} and v.ls().count() == 2


def test_crawl_show_and_dry_run(spark, tmp_path):
    put(str(tmp_path), "one/a.md", "a")
    v = CrawlVault(spark, str(tmp_path), create=True)
    v.add_source("one", str(tmp_path / "one"))
    v.discover()
    assert v.show(os.path.join(os.path.realpath(tmp_path), "one/a.md")).count() == 1 and v.show("x").count() == 0
    os.remove(tmp_path / "one/a.md")
    v.discover()
    assert v.prune(dry_run=True) == 1 and v.ls().count() == 1 and v.prune() == 1 and v.ls().count() == 0
    assert [r["name"] for r in v.sources().collect()] == ["one"] and v.sources("zzz").count() == 0
