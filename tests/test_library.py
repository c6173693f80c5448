"""Document libraries as sources: resolution, both interfaces, links remembered between runs."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from quillmere.engine import CrawlVault
from quillmere.sources import graph, library
from quillmere.sources.local import Unreachable


def item(name, folder="", drive="d1"):
    return {"name": name, "id": name, "size": 5, "webUrl": f"https://h/{drive}/{name}", "lastModifiedDateTime": "2030-01-01T00:00:00Z", "file": {}, "parentReference": {"path": f"/drives/{drive}/root:/{folder}"}}


def fetching(pages):
    def fetch(url):
        if url not in pages:
            raise OSError(f"404 {url}")
        return pages[url]

    return fetch


def test_which_libraries():
    site = {"b/sites/h:/sites/x": {"id": "s"}}
    where = {"site_hostname": "h", "site_path": "sites/x"}
    both = site | {"b/sites/s/drives": {"value": [{"id": "1", "name": "Plans"}], "@odata.nextLink": "n"}, "n": {"value": [{"id": "2", "name": "Notes"}]}}
    assert graph.drives(fetching({}), "b", {"drive_id": "z"}) == [("z", None)]
    assert graph.drives(fetching(both), "b", where) == [("1", "Plans"), ("2", "Notes")]
    assert graph.drives(fetching(site | {"b/sites/s/drive": {"id": "9"}}), "b", where) == [("9", None)]
    for pages, config in ((site | {"b/sites/s/drive": {}}, where), ({}, {})):
        with pytest.raises(Unreachable):
            graph.drives(fetching(pages), "b", config)


def test_runs_of_a_library(spark, tmp_path):
    start = {"value": [item("a.pdf"), item("b.txt", "In%20box")], "@odata.deltaLink": "link1"}
    pages = {"b/drives/d1/root/delta": start, "link1": {"value": [item("c.md")], "@odata.deltaLink": "link2"}, "b/drives/d1/root/children": {"value": [item("a.pdf")]}}
    v = CrawlVault(spark, str(tmp_path), create=True)
    v.add_source("lib", "https://h", "SP", "Delta", base="b", drive_id="d1")
    assert v.discover()["lib"] == {"status": "error"} and v.discover(fetch=fetching({}))["lib"] == {"status": "error"}
    assert v.discover(fetch=fetching(pages))["lib"]["discovered"] == 2
    assert json.loads(v.store.table("sources").first()["config"])["delta_links"] == {"d1": "link1"}
    r = v.discover(fetch=fetching(pages))["lib"]
    assert (r["discovered"], r["gone"]) == (1, 0) and v.ls().count() == 3
    row = v.store.table("sources").first()
    assert json.loads(row["config"])["delta_links"] == {"d1": "link2"} and (row["kind"], row["strategy"], row["last_status"], row["last_error"]) == ("library", "incremental", "ok", None)
    v.add_source("whole", "https://h", "library", base="b", drive_id="d1")
    assert v.discover(["whole"], fetch=fetching(pages))["whole"]["discovered"] == 1


def test_several_libraries_keep_their_names(spark):
    pages = {"b/sites/h:/x": {"id": "s"}, "b/sites/s/drives": {"value": [{"id": "1", "name": "P"}, {"id": "2", "name": "Q"}]}, "b/drives/1/root/children": {"value": [item("a.pdf", drive="1")]}, "b/drives/2/root/children": {"value": [item("a.pdf", drive="2")]}}
    found, remember = graph.discovered(spark, fetching(pages), {"base": "b", "site_hostname": "h", "site_path": "/x"})
    assert sorted(r["rel_path"] for r in found.collect()) == ["P/a.pdf", "Q/a.pdf"] and remember == {}


def test_the_older_interface(spark):
    lists = "https://h/sites/x/_api/web/lists?$select=Title,Hidden,BaseTemplate,RootFolder/ServerRelativeUrl&$expand=RootFolder&$top=500"

    def at(folder, what):
        fields = "Name,ServerRelativeUrl,Length,TimeLastModified" if what == "Files" else "Name,ServerRelativeUrl"
        return f"https://h/sites/x/_api/web/GetFolderByServerRelativeUrl('{folder}')/{what}?$select={fields}&$top=5000"

    def library(title, template=101, hidden=False):
        return {"Title": title, "BaseTemplate": template, "Hidden": hidden, "RootFolder": {"ServerRelativeUrl": f"/sites/x/{title}"}}

    def file(path, length):
        return {"Name": path.rpartition("/")[2], "ServerRelativeUrl": f"/sites/x/{path}", "Length": length, "TimeLastModified": "2024-01-01T00:00:00Z"}

    pages = {
        lists: {"value": [library("Docs"), library("Secret", hidden=True), library("Tasks", 107), library("site assets"), library("Closed")]},
        at("/sites/x/Docs", "Files"): {"value": [file("Docs/a.PDF", "12"), file("Docs/odd", "many"), {"Name": None}]},
        at("/sites/x/Docs", "Folders"): {"value": [{"Name": "Forms", "ServerRelativeUrl": "/sites/x/Docs/Forms"}, {"Name": "It's", "ServerRelativeUrl": "/sites/x/Docs/It's"}]},
        at("/sites/x/Docs/It''s", "Files"): {"value": [file("Docs/It's/b.txt", 7)]}, at("/sites/x/Docs/It''s", "Folders"): {},
    }
    errors = []
    found, _ = graph.discovered(spark, fetching(pages), {"web": "https://h/sites/x/"}, errors=errors)
    rows = sorted((r["uri"], r["rel_path"], r["extension"], r["size"], r["modified_ms"]) for r in found.collect())
    assert rows == [("https://h/sites/x/Docs/It's/b.txt", "Docs/It's/b.txt", "txt", 7, 1704067200000), ("https://h/sites/x/Docs/a.PDF", "Docs/a.PDF", "pdf", 12, 1704067200000), ("https://h/sites/x/Docs/odd", "Docs/odd", None, None, 1704067200000)]
    assert len(errors) == 1 and errors[0].startswith("Closed")
    assert graph.discovered(spark, fetching(pages), {"web": "https://h/sites/x"}, max_depth=1)[0].count() == 2


def test_libraries_as_a_data_source(spark):
    """By tasks: a part for each top folder; the rows are those of a walk, and of discovered()."""
    folder = lambda i: {"id": i, "name": i, "folder": {}}
    pages = {
        "b/drives/d1/root/children": {"value": [item("a.pdf"), folder("f1")], "@odata.nextLink": "more"}, "more": {"value": [folder("f2"), item("z.md")]},
        "b/drives/d1/items/f1/children": {"value": [item("b.txt", "f1"), folder("g")]}, "b/drives/d1/items/g/children": {"value": [item("c.md", "f1/g")]}, "b/drives/d1/items/f2/children": {"value": []},
    }
    fetch = fetching(pages)
    spark.dataSource.register(library.source(fetch))
    found = spark.read.format("library").options(base="b", drive_id="d1").load()
    assert found.rdd.getNumPartitions() == 3 and sorted(r["rel_path"] for r in found.collect()) == ["a.pdf", "f1/b.txt", "f1/g/c.md", "z.md"]
    for depth, want in ((1, ["a.pdf", "z.md"]), (2, ["a.pdf", "f1/b.txt", "z.md"]), (None, ["a.pdf", "f1/b.txt", "f1/g/c.md", "z.md"])):
        assert sorted(r["rel_path"] for r in graph.discovered(spark, fetch, {"base": "b", "drive_id": "d1"}, depth)[0].collect()) == want
    del pages["b/drives/d1/items/g/children"]
    with pytest.raises(Unreachable):
        graph.discovered(spark, fetching(pages), {"base": "b", "drive_id": "d1"})


def test_a_stream_of_changes(spark, tmp_path):
    """Run to completion twice: the second run reads on from the link where the first ended."""
    at = "b/drives/d1/root/delta"
    pages = {at: {"value": [item("a.pdf"), item("b.txt")], "@odata.deltaLink": "link1"}, f"{at}?token=latest": {"value": [], "@odata.deltaLink": "link1"}}
    got = []

    def run():
        spark.dataSource.register(library.source(fetching(pages), "library_stream"))
        rows = spark.readStream.format("library_stream").options(base="b", drive_id="d1").load()
        rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: got.append(sorted(r["name"] for r in df.collect()))).start().awaitTermination()

    run()
    assert [x for x in got if x] == [["a.pdf", "b.txt"]]
    pages |= {"link1": {"value": [item("c.md"), item("gone.md") | {"deleted": {}}], "@odata.deltaLink": "link2"}, f"{at}?token=latest": {"value": [], "@odata.deltaLink": "link2"}}
    got.clear()
    run()
    assert [x for x in got if x] == [["c.md"]]


def site_pages(host, rel, files, broken=False):
    lists = f"https://{host}{rel}/_api/web/lists?$select=Title,Hidden,BaseTemplate,RootFolder/ServerRelativeUrl&$expand=RootFolder&$top=500"
    at = f"https://{host}{rel}/_api/web/GetFolderByServerRelativeUrl('{rel}/Docs')"
    if broken:
        return {}
    return {
        lists: {"value": [{"Title": "Docs", "BaseTemplate": 101, "Hidden": False, "RootFolder": {"ServerRelativeUrl": f"{rel}/Docs"}}, {"Title": "Converted forms", "BaseTemplate": 101, "Hidden": False, "RootFolder": {"ServerRelativeUrl": f"{rel}/CF"}}]},
        f"{at}/Files?$select=Name,ServerRelativeUrl,Length,TimeLastModified&$top=5000": {"value": [{"Name": n, "ServerRelativeUrl": f"{rel}/Docs/{n}", "Length": len(n)} for n in files]}, f"{at}/Folders?$select=Name,ServerRelativeUrl&$top=5000": {"value": []},
    }


def found_sites(paths, total):
    return {"PrimaryQueryResult": {"RelevantResults": {"TotalRows": total, "Table": {"Rows": [{"Cells": [{"Key": "Title", "Value": "t"}, {"Key": "Path", "Value": p}]} for p in paths]}}}}


def test_a_whole_tenant(spark, tmp_path):
    """Two pages of a search; another host and a repeated site are left out, a broken site is an error and no end of the run."""
    search = "https://h/_api/search/query?querytext='contentclass%3ASTS_Site'&rowlimit=100&startrow={}&selectproperties='Path'&trimduplicates=true"
    pages = {
        search.format(0): found_sites(["https://h/sites/x", "https://h-my/personal/q", "https://H/sites/x/"], 102), search.format(100): found_sites(["https://h/sites/y", "https://h/sites/z"], 102),
        **site_pages("h", "/sites/x", ["a.md", "it's.md"]), **site_pages("h", "/sites/y", ["b.txt"]), **site_pages("h", "/sites/z", [], broken=True),
    }
    fetch = fetching(pages)
    assert graph.searched_sites(fetch, "https://h", library.ALL_SITES) == ["https://h/sites/x", "https://h/sites/y", "https://h/sites/z"]
    assert graph.searched_sites(fetch, "https://h", library.ALL_SITES, "sites/y") == ["https://h/sites/y"] and len(graph.searched_sites(fetch, "https://h", library.ALL_SITES, most=1)) == 1
    v = CrawlVault(spark, str(tmp_path), create=True)
    v.add_source("tenant", "https://h", "library", web="https://h", all_sites=True)
    r = v.discover(fetch=fetch)["tenant"]
    assert r["discovered"] == 3 and sorted(x["rel_path"] for x in v.ls().collect()) == ["sites/x/Docs/a.md", "sites/x/Docs/it's.md", "sites/y/Docs/b.txt"]
    run = v.store.table("runs").first()
    assert (run["status"], run["errors"]) == ("partial", 1) and "sites/z" in run["note"]
    root = "https://h/_api/web/GetFileByServerRelativeUrl('/sites/{}')/$value"
    data = {root.format("x/Docs/a.md"): b"a.md", root.format("x/Docs/it''s.md"): b"seven b", root.format("y/Docs/b.txt"): b"other"}
    got = v.fetch(str(tmp_path / "out"), fetching(data), tasks=2, per_second=1000)
    assert (got["fetched"], got["errors"], got["bytes"], got["per_source"]["tenant"]["fetched"]) == (3, 0, 16, 3)
    assert open(tmp_path / "out/tenant/sites/x/Docs/it's.md", "rb").read() == b"seven b" and not [f for f in (tmp_path / "out").rglob("*.????????????????????????????????")]
    again = v.fetch(str(tmp_path / "out"), fetching(data), tasks=2, per_second=1000)
    assert (again["fetched"], again["skipped"]) == (0, 3) or (again["fetched"], again["skipped"]) == (1, 2)  # other's length isn't the registered one


def test_downloads_are_tried_again(spark, tmp_path):
    """Each call fails twice and then goes through; an address that never does is counted; libraries have addresses of their own."""
    tried = str(tmp_path / "tried")
    os.makedirs(tried)

    def get(url):
        n = len([x for x in os.listdir(tried) if x.startswith(url)])
        open(os.path.join(tried, f"{url}-{n}"), "w").close()
        if n < 2 or url == "never":
            raise OSError("busy")
        return url.encode()

    files = spark.createDataFrame([("s", u, str(tmp_path / "o" / u), 5) for u in ("one", "two", "never")], "source string, address string, to string, size long")
    rows = sorted((r["outcome"], r["bytes"]) for r in library.downloaded(files, get, 2, 1000, tries=3, wait=0.01).collect())
    assert rows == [("errors", 0), ("fetched", 3), ("fetched", 3)] and sorted(os.listdir(tmp_path / "o")) == ["one", "two"]
    at = spark.createDataFrame([('{"base": "b"}', "https://h/d1/é?.pdf"), ("{}", "x")], "c string, u string").select(library.download_address(F.col("c"), F.col("u"))).collect()
    assert at[0][0] == "b/shares/u!" + base64.urlsafe_b64encode("https://h/d1/é?.pdf".encode()).decode().rstrip("=") + "/driveItem/content" and at[1][0].startswith(graph.BASE + "/shares/u!eA/")
