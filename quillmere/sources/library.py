"""Document libraries as a data source of Spark's: tasks list folders and sites, a stream goes on from delta links, tasks download."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillmere.functions import scalars as S
from quillmere.session import written
from quillmere.sources import graph

Bytes = Callable[[str], bytes]
#: Sites of a run over all, and the search that finds them, where the configuration says nothing.
MOST_SITES, ALL_SITES = 50, "contentclass:STS_Site"


class Part(InputPartition):
    """kind: "files" (those of an address itself), "folder" (all below it), "site" or "delta"."""

    def __init__(self, kind: str, at: str, drive: str | None = None, prefix: str | None = None) -> None:
        self.kind, self.at, self.drive, self.prefix = kind, at, drive, prefix


def planned(fetch: graph.Fetch, config: dict, max_depth: int | None) -> list[Part]:
    """A part for each site; or for each top folder of each library, and for the files beside them."""
    if web := (config.get("web") or "").rstrip("/"):
        if not config.get("all_sites"):
            return [Part("site", web)]
        sites = graph.searched_sites(fetch, web, config.get("sites_query") or ALL_SITES, config.get("sites_filter"), int(config.get("max_sites") or MOST_SITES))
        return [Part("site", s, prefix=urlsplit(s).path.strip("/") or None) for s in sites]
    base, parts = config.get("base") or graph.BASE, []
    libraries = graph.drives(fetch, base, config)
    for drive, name in libraries:
        prefix, at = name if len(libraries) > 1 else None, graph.children(base, drive, config.get("folder"))
        parts.append(Part("files", at, drive, prefix))
        if max_depth != 1:
            folders = (i for page in graph.paged(fetch, at) for i in page.get("value", []) if "folder" in i)
            parts += [Part("folder", f"{base}/drives/{drive}/items/{i['id']}/children", drive, prefix) for i in folders]
    return parts


def rows_of(fetch: graph.Fetch, part: Part, base: str, max_depth: int | None) -> Iterator[tuple]:
    """RAW rows of a part. A site that can't be read, or a library of it, is a row with a note."""
    if part.kind == "site":
        at, errors = urlsplit(part.at), []
        try:
            for f in graph.rest_walked(fetch, part.at, max_depth, errors):
                if r := graph.rest_row(f, at.netloc, at.path.rstrip("/"), part.prefix):
                    yield r
        except OSError as e:
            errors.append(f"{part.at}: {e}")
        for e in errors:
            yield (None, None, None, None, None, None, None, None, e)
        return
    if part.kind == "delta":
        found: Iterator[dict] | list[dict] = graph.delta(fetch, base, part.drive, part.at or None)[0]
    elif part.kind == "files":
        found = graph.traversed(fetch, base, part.drive, part.at, 1, 1)
    else:
        found = graph.traversed(fetch, base, part.drive, part.at, 2, max_depth)
    for i in found:
        if r := graph.row(i, part.prefix):
            yield (*r, None)


def source(fetch: graph.Fetch, name: str = "library") -> type[DataSource]:
    """A data source to register: `spark.dataSource.register(source(fetch))`, then `spark.read.format("library")` or readStream with
    the options base, drive_id or site_hostname and site_path, folder, web, all_sites, sites_query, sites_filter, max_sites,
    max_depth, delta_links (JSON). Rows are RAW. fetch must be picklable: it runs in tasks. A part that fails is read again alone.

    A stream's offset is each library's delta link. The link that ends a batch is asked for before the batch reads, so a file that
    changes in between comes twice, and none is missed; a registry merges by uri."""

    def options(of) -> tuple[dict, str, int | None]:
        config = dict(of.items())
        depth = config.get("max_depth")
        return config, config.get("base") or graph.BASE, int(depth) if depth else None

    class Reader(DataSourceReader):
        def __init__(self, of) -> None:
            self.config, self.base, self.depth = options(of)

        def partitions(self):
            return planned(fetch, self.config, self.depth)

        def read(self, partition):
            return rows_of(fetch, partition, self.base, self.depth)

    class Stream(DataSourceStreamReader):
        def __init__(self, of) -> None:
            self.config, self.base, _ = options(of)
            self.drives = None

        def libraries(self):
            self.drives = self.drives or graph.drives(fetch, self.base, self.config)
            return self.drives

        def initialOffset(self):
            known = json.loads(self.config.get("delta_links") or "{}")
            return {drive: known.get(drive, "") for drive, _ in self.libraries()}

        def latestOffset(self):
            ends = {}
            for drive, _ in self.libraries():
                for page in graph.paged(fetch, f"{self.base}/drives/{drive}/root/delta?token=latest"):
                    ends[drive] = page.get("@odata.deltaLink", ends.get(drive, ""))
            return ends

        def partitions(self, start, end):
            all_ = self.libraries()
            return [Part("delta", start.get(drive, ""), drive, name if len(all_) > 1 else None) for drive, name in all_]

        def read(self, partition):
            return rows_of(fetch, partition, self.base, None)

    class Library(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return graph.RAW

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return Library


def listed(spark: SparkSession, fetch: graph.Fetch, config: dict, max_depth: int | None = None) -> DataFrame:
    """RAW rows of a library source, listed once by tasks; Unreachable where one of its folders can't be read."""
    if not config.get("web"):
        graph.drives(fetch, config.get("base") or graph.BASE, config)  # says what is wrong with a configuration
    kind = f"library_{uuid.uuid4().hex}"
    spark.dataSource.register(source(fetch, kind))
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in config.items() if v not in (None, False) and not isinstance(v, (dict, list))}
    reader = spark.read.format(kind).options(**options)
    try:
        return written((reader.option("max_depth", max_depth) if max_depth else reader).load(), "library")
    except PySparkException as e:
        raise graph.Unreachable(str(e).splitlines()[-1] if str(e) else repr(e)) from e


def download_address(config, uri):
    """Where a document's bytes are: by the older interface for a source with web, else by the address that shares it."""
    web, base = F.get_json_object(config, "$.web"), F.coalesce(F.get_json_object(config, "$.base"), F.lit(graph.BASE))
    host = F.regexp_extract(web, "^[a-z]+://[^/]+", 0)
    path = F.replace(F.regexp_extract(uri, "(?s)^[a-zA-Z]+://[^/]*(/.*)$", 1), F.lit("'"), F.lit("''"))
    rest = F.concat(host, F.lit("/_api/web/GetFileByServerRelativeUrl('"), path, F.lit("')/$value"))
    return F.when(web.isNotNull(), rest).otherwise(F.concat(base, F.lit("/shares/u!"), S.base64url(uri), F.lit("/driveItem/content")))


def downloaded(files: DataFrame, get: Bytes | None, tasks: int, per_second: float = 10.0, tries: int = 4, wait: float = 1.0) -> DataFrame:
    """source, outcome, bytes of files (source, address, to, size): tasks write what get(address) gives to `to`, under a name of
    their own until it is whole. Files of the right size are there already. Each of the `tasks` makes at most per_second requests a
    second; a failed one is tried again after a wait that doubles, `tries` times in all. get must be picklable; without it addresses are
    paths that are copied."""

    def run(batches):
        import pandas as pd

        due = 0.0
        for b in batches:
            rows = []
            for of, address, to, size in zip(b["source"], b["address"], b["to"], b["size"]):
                if os.path.exists(to) and os.path.getsize(to) == size:
                    rows.append((of, "skipped", 0))
                    continue
                outcome, n = "errors", 0
                for i in range(tries):
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + 1 / per_second
                    try:
                        os.makedirs(os.path.dirname(to), exist_ok=True)
                        part = f"{to}.{uuid.uuid4().hex}"
                        if get is None:
                            shutil.copyfile(address, part)
                        else:
                            data = get(address)
                            with open(part, "wb") as f:
                                f.write(data)
                        os.replace(part, to)
                        outcome, n = "fetched", os.path.getsize(to)
                        break
                    except OSError:
                        if i + 1 < tries:
                            time.sleep(wait * 2**i)
                rows.append((of, outcome, n))
            yield pd.DataFrame(rows, columns=["source", "outcome", "bytes"])

    dealt = files.select("source", "address", "to", "size").repartition(tasks, "address")
    return dealt.mapInPandas(run, "source string, outcome string, bytes long")
