"""Document libraries behind a paged JSON interface: traversal, delta, and rows of items. Fetching is a callable that takes
a URL and returns parsed JSON, so that any authentication can stand behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import scalars as S
from quillmere.sources.local import ITEMS, Unreachable

Fetch = Callable[[str], dict]
# Libraries and folders that hold no documents.
SYSTEM_LIBRARIES = (
    "Form Templates", "Style Library", "Site Assets", "Preservation Hold Library", "Site Collection Documents", "Site Collection Images",
    "Master Page Gallery", "Theme Gallery", "Web Part Gallery", "List Template Gallery", "Solution Gallery", "Converted Forms",
)
SYSTEM_FOLDERS = ("Forms",)
# Fixed value: the public interface of document libraries.
BASE = "https://graph.microsoft.com/v1.0"
#: Rows of a page of a site search.
SEARCHED = 100


def paged(fetch: Fetch, url: str | None) -> Iterator[dict]:
    while url:
        page = fetch(url)
        yield page
        url = page.get("@odata.nextLink")


def children(base: str, drive: str, folder: str | None = None) -> str:
    """Where a drive's root, or a folder of it, is listed."""
    return f"{base}/drives/{drive}/root" + (f":/{quote(folder.strip('/'))}:" if folder else "") + "/children"


def traversed(fetch: Fetch, base: str, drive: str, start: str, depth: int = 1, max_depth: int | None = None) -> Iterator[dict]:
    """File items below an address that lists a folder, whose children are of that depth."""
    todo = [(start, depth)]
    while todo:
        url, depth = todo.pop()
        for page in paged(fetch, url):
            for item in page.get("value", []):
                if "folder" in item:
                    if not max_depth or depth < max_depth:
                        todo.append((f"{base}/drives/{drive}/items/{item['id']}/children", depth + 1))
                elif "file" in item:
                    yield item


def delta(fetch: Fetch, base: str, drive: str, link: str | None = None) -> tuple[list[dict], str | None]:
    """Changed file items since link, without deleted ones, and the link to go on from."""
    found, last = [], link
    for page in paged(fetch, link or f"{base}/drives/{drive}/root/delta"):
        found += [i for i in page.get("value", []) if "file" in i and "deleted" not in i]
        last = page.get("@odata.deltaLink", last)
    return found, last


def row(item: dict, prefix: str | None = None) -> tuple | None:
    """An item as a row of ITEMS: its web address or id, the path after root:, and the first hash there is."""
    uri, name = item.get("webUrl") or item.get("id"), item.get("name")
    if not uri or not name:
        return None
    hashes = (item.get("file") or {}).get("hashes") or {}
    digest = hashes.get("quickXorHash") or hashes.get("sha256Hash") or hashes.get("sha1Hash")
    _, _, below = ((item.get("parentReference") or {}).get("path") or "").partition("root:")
    rel = "/".join(x for x in (prefix, unquote(below).strip("/"), name) if x)
    return (uri, name, rel, None, item.get("size"), None, digest, item.get("lastModifiedDateTime"))


RAW = "uri string, name string, rel_path string, extension string, size long, modified_ms long, content_hash string, modified string, note string"


def items(raw: DataFrame) -> DataFrame:
    """ITEMS of RAW rows that are no errors."""
    found = raw.where(F.col("note").isNull()).withColumns({"extension": S.extension("name"), "modified_ms": S.iso_ms("modified")})
    return found.drop("modified", "note")


def searched_sites(fetch: Fetch, web: str, query: str, contains: str | None = None, most: int = 100) -> list[str]:
    """Addresses of the distinct sites on the web's own host that a paged search finds, of those whose address has a substring;
    `most` of them at most, which is a stated limit of a run."""
    host, found, start = urlsplit(web), {}, 0
    while len(found) < most:
        page = fetch(f"{web}/_api/search/query?querytext='{quote(query)}'&rowlimit={SEARCHED}&startrow={start}&selectproperties='Path'&trimduplicates=true")
        results = (page.get("PrimaryQueryResult") or {}).get("RelevantResults") or {}
        rows = (results.get("Table") or {}).get("Rows") or []
        paths = [c["Value"] for r in rows for c in r.get("Cells") or [] if c.get("Key") == "Path" and c.get("Value")]
        for p in paths:
            at = urlsplit(p)
            if at.netloc.lower() == host.netloc.lower() and (not contains or contains in p):
                found.setdefault(f"{host.scheme}://{host.netloc}{at.path.rstrip('/')}")
        start += SEARCHED
        if not paths or start >= (results.get("TotalRows") or 0):
            break
    return list(found)[:most]


def drives(fetch: Fetch, base: str, config: dict) -> list[tuple[str, str | None]]:
    """(id, name) of the libraries to list: the one that drive_id names, else all of the site at site_hostname and site_path, else
    the site's default one."""
    if config.get("drive_id"):
        return [(config["drive_id"], None)]
    if not (config.get("site_hostname") and config.get("site_path")):
        raise Unreachable("a library source takes drive_id, or site_hostname and site_path")
    site = fetch(f"{base}/sites/{config['site_hostname']}:/{config['site_path'].strip('/')}")
    if not site.get("id"):
        raise Unreachable(f"no site at {config['site_hostname']}/{config['site_path']}")
    try:
        found = [(d["id"], d.get("name")) for page in paged(fetch, f"{base}/sites/{site['id']}/drives") for d in page.get("value", []) if d.get("id")]
    except OSError:  # the list may be closed to those who may read the default library
        found = []
    if found:
        return found
    default = fetch(f"{base}/sites/{site['id']}/drive")
    if not default.get("id"):
        raise Unreachable(f"no library of {config['site_hostname']}/{config['site_path']} can be read")
    return [(default["id"], None)]


def rest_walked(fetch: Fetch, web: str, max_depth: int | None = None, errors: list | None = None) -> Iterator[dict]:
    """Files of a site's visible document libraries by the older interface, without the system's libraries and folders. The files of
    a library's root are depth 1. A library that can't be read goes to errors."""
    lists = fetch(f"{web}/_api/web/lists?$select=Title,Hidden,BaseTemplate,RootFolder/ServerRelativeUrl&$expand=RootFolder&$top=500")
    left_out = {t.lower() for t in SYSTEM_LIBRARIES}
    for library in lists.get("value", []):
        root = (library.get("RootFolder") or {}).get("ServerRelativeUrl")
        if library.get("BaseTemplate") != 101 or library.get("Hidden") or not root or (library.get("Title") or "").lower() in left_out:
            continue
        todo = [(root, 1)]
        try:
            while todo:
                folder, depth = todo.pop()
                at = f"{web}/_api/web/GetFolderByServerRelativeUrl('" + folder.replace("'", "''") + "')"
                yield from fetch(f"{at}/Files?$select=Name,ServerRelativeUrl,Length,TimeLastModified&$top=5000").get("value", [])
                if not max_depth or depth < max_depth:
                    below = fetch(f"{at}/Folders?$select=Name,ServerRelativeUrl&$top=5000").get("value", [])
                    todo += [(f["ServerRelativeUrl"], depth + 1) for f in below if f.get("Name") and f["Name"] not in SYSTEM_FOLDERS and f.get("ServerRelativeUrl")]
        except OSError as e:
            if errors is not None:
                errors.append(f"{library.get('Title')}: {e}")


def rest_row(f: dict, host: str, site_path: str = "", prefix: str | None = None) -> tuple | None:
    """A file of the older interface as a RAW row; sizes come as text or numbers, paths go without the site's."""
    name, at, length = f.get("Name"), f.get("ServerRelativeUrl"), f.get("Length")
    if not name or not at:
        return None
    below = at.removeprefix(site_path).lstrip("/")
    size = int(length) if length is not None and str(length).isdigit() else None
    return (f"https://{host}{at}", name, "/".join(x for x in (prefix, below) if x), None, size, None, None, f.get("TimeLastModified"), None)


def discovered(spark: SparkSession, fetch: Fetch, config: dict, max_depth: int | None = None, incremental: bool = False, errors: list | None = None) -> tuple[DataFrame, dict]:
    """Items of a library source, and what its configuration must remember. Tasks list (see library.source): a site or a top folder
    each. With web, by the older interface, with all_sites every site that a search finds; what can't be read there goes to errors.
    An incremental run goes on from each library's last link. With several libraries, paths start with the library's name."""
    from quillmere.sources import library

    if incremental and not config.get("web"):
        base, links, all_, rows = config.get("base") or BASE, dict(config.get("delta_links") or {}), drives(fetch, config.get("base") or BASE, config), []
        for drive, name in all_:
            changed, link = delta(fetch, base, drive, links.get(drive))
            links |= {drive: link} if link else {}
            rows += [r for i in changed if (r := row(i, name if len(all_) > 1 else None))]
        return items(spark.createDataFrame([(*r, None) for r in rows], RAW)), {"delta_links": links}
    found = library.listed(spark, fetch, config, max_depth)
    if errors is not None:
        errors += [r["note"] for r in found.where("note IS NOT NULL").orderBy("note").limit(100).collect()]
    return items(found), {}
