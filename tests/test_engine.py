import os
import time

import pytest

from quillmere.engine import ConvertVault, CrawlVault, IndexVault
from quillmere.operators.embed import HashEmbedder
from quillmere.sources import graph
from quillmere.store import Locked, Store


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)
    return full


def sound(v):
    assert set(v.check().values()) == {0}


def test_index_lifecycle(spark, tmp_path):
    root = str(tmp_path)
    put(root, "harbour.md", "# Harbour\n\n## Moorings\n\nGrey gulls circle the moorings at dusk.")
    put(root, "lantern.md", "# Lantern room\n\n## Oil\n\nThe keeper fills both lamps before nightfall.")
    put(root, "empty.md", "")
    put(root, "img.png", "x")
    put(root, ".git/config", "x")
    v = IndexVault(spark, root, create=True, embedder=HashEmbedder(32))
    assert v.add()["added"] == 3 and v.add()["already_registered"] == 3
    r = v.index()
    assert (r["indexed"], r["failed"], r["chunks_added"]) == (2, 1, 2)
    sound(v)
    assert v.index() == {"skipped": 3, "chunks_added": 0, "chunks_replaced": 0}
    assert v.index(retry_failed=True)["failed"] == 1
    hits = v.search("moorings", mode="keyword").collect()
    assert [h["path"] for h in hits] == ["harbour.md"] and hits[0]["heading_path"] == "Harbour > Moorings"
    assert {h["path"] for h in v.search("moorings").collect()} == {"harbour.md", "lantern.md"}
    assert [h["path"] for h in v.search("lamps", path_glob="lantern.md").collect()] == ["lantern.md"]
    assert v.search("lamps", path_glob="cellar*.md").count() == 0 and v.search("lamps", threshold=99.0).count() == 0
    assert v.search("", mode="keyword").count() == 0 and v.search('NOT (quince OR "fig tart") ^ *').count() >= 0 and v.search("lamps", k=1).count() == 1
    full = put(root, "lantern.md", "# Lantern room\n\nThe lens was replaced.")
    os.utime(full, (time.time() + 10, time.time() + 10))
    old = {r["id"] for r in v.show("lantern.md").collect()}
    r = v.index()
    assert r["indexed"] == 1 and r["chunks_replaced"] == 1 and not old & {r["id"] for r in v.show("lantern.md").collect()}
    os.remove(os.path.join(root, "harbour.md"))
    assert v.index()["missing"] == 1
    sound(v)
    s = v.status()
    assert s["missing"] == 1 and s["indexed"] == 1 and s["untracked"] == 0
    assert v.prune() == {"missing": 1} and v.prune(all_non_indexed=True) == {"failed": 1}
    assert v.remove(["lantern.md", "absent.md"]) == {"removed": ["lantern.md"], "not_found": ["absent.md"]}
    assert v.store.table("chunks").count() == 0
    sound(v)


def test_convert_lifecycle(spark, tmp_path):
    root = str(tmp_path)
    put(root, "docs/a.md", "# Tides\n\nlow water at six.")
    put(root, "docs/b.txt", "a list of buoys")
    v = ConvertVault(spark, root, create=True)
    put(root, ".mdignore", "drafts/\n*.tmp.md\n")
    put(root, "drafts/x.md", "not yet")
    put(root, "docs/y.tmp.md", "not yet")
    put(root, "converted/old.md", "an output")
    assert v.add(["docs", "drafts", "converted"], dry_run=True) == {"added": 2, "already_registered": 0, "skipped": 1} and v.ls().count() == 0
    assert v.add(["docs", "drafts", "converted"])["added"] == 2 and v.add(["docs"])["already_registered"] == 2
    assert v.convert() == {"converted": 2} and v.convert() == {"skipped": 2}
    out = os.path.join(root, "converted/docs/a.md.md")
    assert v.whence("converted/docs/a.md.md") == ("docs/a.md", "db")
    put(root, "copy.md", open(out).read())
    assert v.whence("copy.md") == ("docs/a.md", "annotation") and v.whence("none.md") is None
    put(root, "converted/docs/a.md.md", "edited")
    assert v.convert() == {"skipped": 2} and v.convert(force=True)["skipped"] == 1
    put(root, "docs/a.md", "# Tides\n\nhigh water at noon.")
    assert v.convert()["conflict"] == 1 and os.path.exists(out + ".new")
    assert v.convert(keep_existing=True)["converted"] == 1
    put(root, "docs/a.md", "# Tides\n\nslack water.")
    assert v.convert(overwrite=True)["converted"] == 1 and "slack" in open(out).read()


def test_convert_status_remove_prune(spark, tmp_path):
    root = str(tmp_path)
    for name in ("one", "two", "three"):
        put(root, f"{name}.md", f"# {name}\n\ntext of {name}")
    v = ConvertVault(spark, root, create=True)
    assert v.add()["added"] == 3 and v.convert() == {"converted": 3}
    put(root, "one.md", "# one\n\nchanged")
    put(root, "converted/two.md.md", "edited")
    put(root, "three.md", "# three\n\nchanged")
    put(root, "converted/three.md.md", "edited")
    s = v.status()
    assert (s["converted"], s["source_changed"], s["output_modified"], s["would_conflict"], s["lost"]) == (3, 1, 1, 1, 0)
    os.remove(os.path.join(root, "two.md"))
    v.store.set("convert.size_cap_bytes", 10)
    r = v.convert()
    assert r["missing"] == 1 and r["too_large"] == 2
    v.store.set("convert.size_cap_bytes", None)
    r = v.convert(keep_existing=True)
    kept = v.ls().where("input_path = 'three.md'").first()
    assert r["converted"] == 2 and kept["status"] == "converted" and kept["status_detail"] is None and kept["last_attempt"] > 0
    assert v.prune(dry_run=True) == {"missing": 1} and v.ls().count() == 3 and v.prune() == {"missing": 1}
    assert v.remove(["one.md", "none.md"]) == {"removed": ["one.md"], "not_found": ["none.md"]} and v.prune(all_non_converted=True) == {}
    assert [r["input_path"] for r in v.ls().collect()] == ["three.md"] and os.path.exists(os.path.join(root, "converted/one.md.md"))


def test_sources_of_one_folder_and_their_settings(spark, tmp_path):
    root, vault = str(tmp_path / "src"), str(tmp_path / "vault")
    os.makedirs(vault)
    for p in ("fir.txt", "deep/ash.txt", "deep/er/bay.md"):
        put(root, p, p)
    v = CrawlVault(spark, vault, create=True)
    v.add_source("all", root)
    v.add_source("top", root, max_depth=1)
    v.add_source("some", root, include=["deep/*"], exclude=["**/*.md"])
    for bad in ({"kind": "ftp"}, {"depth": 1}):
        with pytest.raises(ValueError):
            v.add_source("bad", root, **bad)
    r = v.discover()
    assert [r[n]["discovered"] for n in ("all", "top", "some")] == [3, 1, 1]
    d = v.store.table("documents")
    assert d.count() == 5 and d.select("id").distinct().count() == 5 and set(v.check().values()) == {0}
    assert [(x["name"], x["n_documents"]) for x in v.info().collect()] == [("all", 3), ("some", 1), ("top", 1)]
    assert v.find("ASH").count() == 2 and v.remove_uris([os.path.join(root, "deep/ash.txt")]) == 2 and v.find("ash").count() == 0
    v.add_source("gone", str(tmp_path / "none"))
    assert v.discover(["gone"])["gone"]["status"] == "error"
    last = v.store.table("runs").orderBy("id").collect()[-1]
    assert (last["status"], last["errors"]) == ("error", 1)


def test_store_keeps_two_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path), {"t": "x long"}, create=True)
    for n in range(4):
        before = s.table("t")
        s.commit({"t": spark.range(n + 1).withColumnRenamed("id", "x")}, {"t": [["x"]]})
        assert before.count() == n
    assert len(os.listdir(tmp_path / ".quillmere/t")) == 2
    with pytest.raises(ValueError):
        s.commit({"t": spark.createDataFrame([(1,), (1,)], "x long")}, {"t": [["x"]]})
    assert s.table("t").count() == 4


def test_crawl_lifecycle(spark, tmp_path):
    root, vault = str(tmp_path / "src"), str(tmp_path / "vault")
    os.makedirs(vault)
    for p, t in (("oak.pdf", "acorn"), ("elm.txt", "leaf"), ("grove/yew.md", "berry"), ("core.bin", "x")):
        put(root, p, t)
    v = CrawlVault(spark, vault, create=True)
    v.add_source("local", root)
    assert v.discover(dry_run=True)["local"]["discovered"] == 3 and v.ls().count() == 0
    r = v.discover()["local"]
    assert (r["discovered"], r["skipped"]) == (3, 1)
    assert v.discover()["local"]["updated"] == 0
    put(root, "elm.txt", "leaf and twig")
    assert v.discover()["local"]["updated"] == 1 and v.status()["modified"] == 1
    v.discover()
    assert v.status()["modified"] == 0
    out = str(tmp_path / "out")
    assert v.fetch(out)["fetched"] == 3 and v.fetch(out)["skipped"] == 3
    assert v.export("csv").count() == 3 and v.export("jsonl").count() == 3
    os.remove(os.path.join(root, "oak.pdf"))
    assert v.discover()["local"]["gone"] == 1 and v.ls().count() == 3 and v.prune() == 1 and v.ls().count() == 2
    assert [r["name"] for r in v.ls(like="W.M").collect()] == ["yew.md"]
    v.add_source("away", str(tmp_path / "nowhere"))
    assert v.discover(["away"])["away"]["status"] == "error"
    assert v.remove_source("local") and v.ls().count() == 0 and not v.remove_source("local")


def test_strategies():
    base = {"last_crawled": 5}
    assert CrawlVault.plan(base | {"strategy": "shallow"})["max_depth"] == 1
    assert CrawlVault.plan(base | {"strategy": "incremental"})["since_ms"] == 5
    assert CrawlVault.plan(base | {"strategy": "targeted"})["include"] == ["**/*"]


def test_graph_pages(spark):
    item = {"name": "a.pdf", "id": "1", "size": 3, "webUrl": "https://h/a.pdf", "lastModifiedDateTime": "2024-01-01T00:00:00Z", "file": {"hashes": {"quickXorHash": "q"}}, "parentReference": {"path": "/drives/d/root:/Top%20x"}}
    pages = {
        "b/drives/d/root/children": {"value": [item, {"folder": {}, "id": "f", "name": "Sub"}], "@odata.nextLink": "next"}, "next": {"value": [item | {"name": "b.docx", "webUrl": "https://h/b.docx"}]},
        "b/drives/d/items/f/children": {"value": [item | {"name": "c.txt", "webUrl": "https://h/c.txt"}]},
        "b/drives/d/root/delta": {"value": [item, {"id": "9", "deleted": {}, "file": {}}], "@odata.deltaLink": "token=final"},
    }
    assert len(list(graph.traversed(pages.get, "b", "d", graph.children("b", "d")))) == 3 and len(list(graph.traversed(pages.get, "b", "d", graph.children("b", "d"), max_depth=1))) == 2
    found, link = graph.delta(pages.get, "b", "d")
    row = graph.items(spark.createDataFrame([(*graph.row(i), None) for i in found], graph.RAW)).first()
    assert link == "token=final" and (row["rel_path"], row["extension"], row["content_hash"], row["modified_ms"]) == ("Top x/a.pdf", "pdf", "q", 1704067200000)


def test_store_lock_and_settings(spark, tmp_path):
    s = Store(spark, str(tmp_path), {}, create=True)
    with s.lock(), pytest.raises(Locked), Store(spark, str(tmp_path), {}).lock(0):
        pass
    s.set("retrieval.default_k", 3)
    assert s.get("retrieval.default_k") == 3 and s.get("chunking.max_tokens") == 800
    with pytest.raises(ValueError):
        s.set("retrieval.default_k", "3")
    os.makedirs(tmp_path / "x/y")
    assert Store.discover(spark, str(tmp_path / "x/y"), {}).root == str(tmp_path)


def test_stream_discovery(spark, tmp_path):
    from quillmere.streaming.discovery import watch

    put(str(tmp_path / "in"), "a.txt", "x")
    seen = []
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, i: seen.extend(r["path"] for r in df.collect()))
    assert len(seen) == 1
