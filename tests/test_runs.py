"""Tables in runs: a commit writes what changed, readers see the live rows, merging changes nothing that is read."""

import json
import os

import pytest
from test_engine import put

from quillmere import store
from quillmere.engine import IndexVault
from quillmere.operators.embed import HashEmbedder

SCHEMAS = {"files": "id long, path string, n long"}


def live(s):
    return sorted((r["path"], r["n"]) for r in s.table("files").collect())


def frame(spark, rows):
    return spark.createDataFrame([(hash(p) % 10**9, p, n) for p, n in rows], SCHEMAS["files"])


def keys(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_against_a_dictionary(spark, tmp_path, monkeypatch):
    """Replacing, deleting and adding in any order, with merges in between, is what a dictionary does; the folders that no version
    needs are gone."""
    monkeypatch.setattr(store, "TIER", 3)
    s, want = store.Store(spark, str(tmp_path), SCHEMAS, create=True), {}
    steps = [([("a", 1), ("b", 1)], []), ([("c", 2)], ["a"]), ([("a", 3)], ["a", "x"]), ([], ["b"]), ([("b", 4), ("d", 4)], []), ([("c", 5)], ["c"]), ([], []), ([("e", 6)], ["d", "e"])]
    for add, gone in steps:
        s.append({"files": frame(spark, add)}, {"files": keys(spark, gone)}, {"files": [["path"], ["id"]]})
        want = {k: v for k, v in want.items() if k not in gone} | dict(add)
        assert live(s) == sorted(want.items())
    s.merge(whole=True)
    assert live(s) == sorted(want.items()) and len(s._parts("files")["runs"]) == 1 and not s._parts("files")["deletes"]
    assert s.merge(whole=True) == {}
    s.append({"files": frame(spark, [("z", 1)])})
    kept = {x["path"] for k in s._parts("files").values() for x in k} | set(s._state()["old"])
    assert {os.path.join(s.home, "files", x) for x in os.listdir(os.path.join(s.home, "files"))} == kept


def test_a_refused_commit_leaves_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), SCHEMAS, create=True)
    s.append({"files": frame(spark, [("a", 1)])})
    before = sorted(os.listdir(os.path.join(s.home, "files")))
    for rows in ([("a", 2)], [("b", 2), ("b", 3)]):
        with pytest.raises(ValueError, match="path must be unique"):
            s.append({"files": frame(spark, rows)}, unique={"files": [["path"]]})
    with pytest.raises(ValueError, match="unique"):
        s.commit({"files": frame(spark, [("b", 2), ("b", 3)])}, {"files": [["path"]]})
    assert sorted(os.listdir(os.path.join(s.home, "files"))) == before and live(s) == [("a", 1)]


def test_a_store_of_whole_tables_goes_on(spark, tmp_path):
    """A pointer that names one path a table, rows without a version."""
    s = store.Store(spark, str(tmp_path), SCHEMAS, create=True)
    path = os.path.join(s.home, "files", "old")
    frame(spark, [("a", 1), ("b", 1)]).write.parquet(path)
    with open(os.path.join(s.home, "current.json"), "w") as f:
        json.dump({"tables": {"files": path}, "settings": {}, "version": 4, "old": {"files": "/nowhere"}}, f)
    assert live(s) == [("a", 1), ("b", 1)]
    s.append({"files": frame(spark, [("b", 2)])}, {"files": keys(spark, ["b"])}, {"files": [["path"]]})
    assert live(s) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize(("sizes", "n"), [([], 0), ([1] * 7, 0), ([1] * 8, 8), ([9 << 20] + [1] * 7, 0), ([9 << 20] + [1] * 8, 8), ([9 << 20] * 7 + [1] * 8, 8), ([9 << 20] * 8 + [1] * 3, 11), ([1] * 3 + [9 << 20] + [1] * 7, 0)])
def test_which_runs_are_due(sizes, n):
    assert store.due(sizes) == n


def written_since(root, before):
    now = {os.path.join(at, f) for at, _, files in os.walk(root) for f in files}
    return sum(os.path.getsize(p) for p in now - before), now


def test_one_changed_file_writes_in_proportion(spark, tmp_path):
    """The bytes that a run over one changed file writes don't grow with the vault; search is the same before and after merging, and the
    same as that of a vault built at once."""
    root, wrote = str(tmp_path / "a"), {}
    v = None
    for n in (100, 500):
        for i in range(0 if n == 100 else 100, n):
            put(root, f"n/{i}.md", f"# Note {i}\n\nHarbour number{i} faces the shore. " + f"tide{i % 7} word{i % 31} " * 120)
        v = v or IndexVault(spark, root, create=True, embedder=HashEmbedder(64))
        v.add()
        v.index()
        v.store.merge(whole=True)
        full = put(root, "n/5.md", f"# Note 5\n\nThe lighthouse after {n}.")
        os.utime(full, (2e9 + n, 2e9 + n))
        _, seen = written_since(v.store.home, set())
        whole = sum(os.path.getsize(p) for p in seen)
        assert v.index()["indexed"] == 1
        wrote[n], _ = written_since(v.store.home, seen)
        assert set(v.check().values()) == {0} and v.results().groupBy("outcome").count().count() == 2
    assert wrote[500] < 1.2 * wrote[100] and wrote[500] < whole / 5
    found = lambda v, q: [(r["path"], r["ordinal"], round(r["score"], 9)) for r in v.search(q, k=20).collect()]
    queries = ("lighthouse", "harbour number7", "tide3 word4", "shore")
    before = [found(v, q) for q in queries]
    assert v.search("lighthouse", mode="keyword").first()["path"] == "n/5.md" and v.search("number5", mode="keyword").count() == 0
    assert v.store.merge(whole=True) and [found(v, q) for q in queries] == before and v.store._parts("postings")["deletes"] == []
    keyword = v.store.table("postings").where("term in ('tide3', 'word4')")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [tide3,word4])]" in keyword
