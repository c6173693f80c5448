"""Walking and looking at files by tasks: rounds, pruning, links, errors, and the vaults that use them."""

import os

import pytest
from test_engine import put

from quillmere.engine import ConvertVault, CrawlVault, IndexVault
from quillmere.functions import globs
from quillmere.operators.embed import HashEmbedder
from quillmere.sources import local


def brute(root, ignore=(), max_depth=None):
    """Files by os.walk, without what rules ignore."""
    said, found = globs.Ignorer(ignore), []
    for at, folders, files in os.walk(root):
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        folders[:] = [] if max_depth and rel.count("/") + 1 >= max_depth else [f for f in folders if not said(rel + f, True) and not os.path.islink(os.path.join(at, f))]
        found += [rel + f for f in files if not said(rel + f) and not os.path.islink(os.path.join(at, f))]
    return sorted(found)


@pytest.fixture(scope="module")
def woods(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("woods"))
    for i in range(60):
        put(root, f"{'abc'[i % 3]}/{i % 7}/{'deep/' * (i % 5)}leaf{i}.md", f"leaf {i}")
    put(root, "top.txt", "top")
    put(root, ".git/config", "no")
    put(root, "b/2/cache/skip.md", "no")
    os.symlink(os.path.join(root, "a"), os.path.join(root, "b", "link"))
    os.symlink(root, os.path.join(root, "c", "round"))
    return root


@pytest.mark.parametrize("entries", [20_000, 1])
def test_tree_is_the_walk(spark, woods, monkeypatch, entries):
    """In one round, and in as many as there are levels."""
    monkeypatch.setattr(local, "ENTRIES", entries)
    for ignore, depth in (((), None), (["cache/", "*7.md", "!leaf27.md"], None), ((), 2), ((), 1)):
        rows = local.tree(spark, woods, ignore_lines=ignore, max_depth=depth).where("kind = 'file'").collect()
        assert sorted(r["path"] for r in rows) == brute(woods, ignore, depth)
        assert all(r["size"] == os.path.getsize(r["full"]) and r["modified_ms"] == int(os.path.getmtime(r["full"]) * 1000) for r in rows)
    some = local.tree(spark, woods, starts=["a/3", "b"], leave=["b/1"]).collect()
    assert sorted(r["path"] for r in some) == [p for p in brute(woods) if p.startswith(("a/3/", "b/")) and not p.startswith("b/1/")]


def test_links_and_errors(spark, woods, tmp_path):
    errors = []
    found = {r["rel_path"] for r in local.items(spark, woods, follow_links=True, errors=errors).collect()}
    assert any(p.startswith("b/link/") for p in found) and not any(p.startswith("c/round/") for p in found)
    assert len(errors) >= 1 and all("round leads back" in e for e in errors)
    errors.clear()
    gone = local.tree(spark, woods, starts=["a/3", "nowhere"]).where("kind = 'error'").collect()
    assert [r["path"] for r in gone] == ["nowhere"]
    assert local.items(spark, str(tmp_path)).count() == 0


def test_stats(spark, woods):
    rows = spark.createDataFrame([("top.txt", 1), ("a", 2), ("zzz", 3)], "path string, size int")
    got = {r["path"]: (r["exists"], r["is_file"], r["size"]) for r in local.stats(spark, woods, rows).collect()}
    assert got["top.txt"] == (True, True, 3) and got["a"][:2] == (True, False) and got["zzz"] == (False, False, None)


def test_vaults_walk_by_tasks(spark, tmp_path):
    root = str(tmp_path)
    for p in ("a.md", "drafts/keep.md", "drafts/x.md", "notes/b.md", "notes/c.bin", "out.md", "#odd.md"):
        put(root, p, "words")
    put(root, ".vaultignore", "drafts/\n!drafts/keep.md\n**/b.md\n\\#odd.md\n")
    put(root, ".mdignore", "notes/\n")
    v = IndexVault(spark, root, create=True, embedder=HashEmbedder(8))
    assert v.status()["untracked"] == 2
    assert v.add(["notes", "drafts/keep.md"])["added"] == 1  # a file that is named is judged by itself
    assert [r["path"] for r in v.ls().collect()] == ["drafts/keep.md"]
    assert v.add()["added"] == 2 and [r["path"] for r in v.ls().collect()] == ["a.md", "drafts/keep.md", "out.md"] and v.status()["untracked"] == 0
    os.remove(os.path.join(root, "out.md"))
    s = v.status()
    assert (s["would_process"], s["lost"], s["registered"], s["modified"], s["prune_would_remove"]) == (2, 1, 3, 0, 0)
    v.store.set("retrieval.default_k", 3)
    assert ("retrieval.default_k", 3, "set") in v.store.origins() and ("retrieval.rrf_constant", 60, "default") in v.store.origins()
    assert [r["decision"] for r in v.decided(paths=["a.md"]).collect()] == ["work"]
    c = ConvertVault(spark, str(tmp_path / "notes"), create=True)
    assert c.add()["added"] == 1
    whole = ConvertVault(spark, root, create=True)
    whole.add()
    assert [r["input_path"] for r in whole.ls().collect()] == ["#odd.md", "a.md", "drafts/keep.md", "drafts/x.md"]


def test_crawl_status_and_settings(spark, tmp_path):
    """Sources, what their last runs were the first to see, hashes by setting, and a source's own ignore file."""
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for p in ("a.md", "b.md", "tmp/c.md"):
        put(one, p, p)
    put(one, ".crawlignore", "tmp/\n")
    put(two, "d.txt", "d")
    v = CrawlVault(spark, str(tmp_path), create=True)
    v.store.set("crawl.hash", True)
    v.add_source("one", one)
    v.add_source("two", two)
    v.add_source("off", two)
    v.enable("off", False)
    v.discover()
    assert v.ls().where("content_hash IS NULL").count() == 0 and v.ls().count() == 3
    put(one, "new.md", "new")
    v.discover(["one"])
    s = v.status()
    assert (s["documents"], s["present"], s["new_last_run"], s["sources"], s["sources_enabled"]) == (4, 4, 2, 3, 2)
    assert [(x["name"], x["documents"], x["last_status"]) for x in s["per_source"]] == [("off", 0, None), ("one", 3, "ok"), ("two", 1, "ok")]
