"""Local trees and mounted shares as DataFrames of items."""

from __future__ import annotations

import collections
import functools
import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import globs
from quillmere.functions import scalars as S
from quillmere.session import written

ITEMS = "uri string, name string, rel_path string, extension string, size long, modified_ms long, content_hash string"
LISTED = "kind string, path string, name string, depth int, full string, size long, modified_ms long, note string"
LISTED_NAMES = [x.split()[0] for x in LISTED.split(", ")]
#: Entries that a task lists in one round before it hands folders on.
ENTRIES = 20_000


class Unreachable(Exception):
    """The source's root is no folder that can be read."""


def root_of(uri: str) -> str:
    path = os.path.realpath(uri.removeprefix("file://"))
    if not os.path.isdir(path):
        raise Unreachable(uri)
    return path


def share_of(uri: str) -> tuple[str | None, str | None]:
    rest = uri.replace("\\", "/")
    for scheme in ("smb:", "cifs:", "nfs:"):
        rest = rest.removeprefix(scheme)
    parts = [p for p in rest.split("/") if p]
    return (parts[0] if parts else None, parts[1] if len(parts) > 1 else None)


def mount_of(uri: str, mount: str | None = None, user: str | None = None) -> str:
    """Where a share is mounted: the named mount, the path itself, or the usual places."""
    host, share = share_of(uri)
    places = [mount, uri, f"/Volumes/{share}", f"/mnt/{share}", f"/media/{user or os.environ.get('USER', '')}/{share}", f"/Volumes/{host}"]
    for p in places:
        if p and os.path.isdir(p):
            return os.path.realpath(p)
    raise Unreachable(uri)


def expand(root: str, starts, ignore: globs.Ignorer, max_depth: int | None, follow_links: bool, leave: frozenset[str], most: int):
    """Rows of LISTED: the files below folders (rel_path, depth), each with its size and time where it is listed. Once `most` entries
    were seen, further folders are handed on as rows instead of being entered; those given always are."""
    given, seen = len(starts), 0
    todo = collections.deque(starts)
    while todo:
        folder, depth = todo.popleft()
        given -= 1
        if given < 0 and seen >= most:
            yield ("folder", folder, None, depth, None, None, None, None)
            continue
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError as e:
            yield ("error", folder, None, depth, None, None, None, str(e))
            continue
        for e in entries:
            seen += 1
            rel = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_dir(follow_symlinks=follow_links):
                    if ignore(rel, True) or rel in leave or max_depth and depth >= max_depth:
                        continue
                    if e.is_symlink() and (os.path.realpath(os.path.join(root, folder)) + os.sep).startswith(os.path.realpath(e.path) + os.sep):
                        yield ("error", rel, None, depth, None, None, None, f"{e.path} leads back to itself")
                        continue
                    todo.append((rel, depth + 1))
                elif e.is_file(follow_symlinks=follow_links):
                    s = e.stat(follow_symlinks=follow_links)
                    yield ("ignored" if ignore(rel) else "file", rel, e.name, depth, os.path.join(root, rel), s.st_size, int(s.st_mtime * 1000), None)
            except OSError as x:  # gone or closed between listing and looking
                yield ("error", rel, None, depth, None, None, None, str(x))


def tree(spark: SparkSession, root: str, starts=("",), max_depth: int | None = None, follow_links: bool = False, ignore_lines=(), built_in: bool = True, leave=()) -> DataFrame:
    """LISTED: files below `starts`, folders relative to root, ignored files, and errors of what can't be read. Ignored folders and
    those in `leave` aren't entered, nor are such starts; the files of a start are depth 1.

    Tasks walk: each expands the folders dealt to it, down to ENTRIES entries, and hands the rest on to the next round, so that large
    trees spread and small ones take one round. A round is written once; only whether there is another reaches the driver."""
    ignore, leave, rounds = globs.Ignorer(ignore_lines, built_in), frozenset(leave), []
    starts = [s for s in starts if not s or not (ignore(s, True) or any(s == x or s.startswith(x + "/") for x in leave))]
    frontier = spark.createDataFrame([(s, 1) for s in starts], "path string, depth int")
    most = ENTRIES

    def run(batches):
        import pandas as pd

        for b in batches:
            folders = list(zip(b["path"], (int(d) for d in b["depth"])))
            yield pd.DataFrame(list(expand(root, folders, ignore, max_depth, follow_links, leave, most)), columns=LISTED_NAMES).astype({"size": "Int64", "modified_ms": "Int64"})

    while True:
        rounds.append(written(frontier.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, LISTED), "tree"))
        frontier = rounds[-1].where("kind = 'folder'").select("path", "depth")
        if frontier.isEmpty():
            break
    found = functools.reduce(DataFrame.unionByName, rounds)
    return found.where("kind <> 'folder'")


def items(spark: SparkSession, root: str, errors: list | None = None, **how) -> DataFrame:
    """Rows of ITEMS below root (see tree), with the messages of up to a hundred errors, and how many there are beyond, in `errors`."""
    found = tree(spark, root_of(root), **how)
    if errors is not None:
        bad = found.where("kind = 'error'")
        errors += [r["note"] for r in bad.orderBy("path").limit(100).collect()]
        if len(errors) == 100 and (more := bad.count() - 100) > 0:
            errors.append(f"{more} more")
    files = found.where("kind = 'file'")
    return files.select(F.col("full").alias("uri"), "name", F.col("path").alias("rel_path"), S.extension("name").alias("extension"), "size", "modified_ms", F.lit(None).cast("string").alias("content_hash"))


def stats(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path, exists, is_file, size, mtime, full of registered paths (one column), by tasks."""
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p in b["path"]:
                full = os.path.join(root, p)
                try:
                    s = os.stat(full)
                    rows.append((p, True, stat.S_ISREG(s.st_mode), s.st_size, int(s.st_mtime * 1000), full))
                except OSError:
                    rows.append((p, False, False, None, None, full))
            yield pd.DataFrame(rows, columns=["path", "exists", "is_file", "size", "mtime", "full"]).astype({"size": "Int64", "mtime": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, exists boolean, is_file boolean, size long, mtime long, full string")


def kept(items_: DataFrame, extensions=(), excluded=(), include=(), exclude=(), since_ms: int | None = None) -> DataFrame:
    """Items that pass the extension, glob and time filters; an item without a time passes the last."""
    out = items_.where(globs.ext_ok(F.col("extension"), list(extensions), list(excluded)))
    out = out.where(globs.path_ok(F.col("rel_path"), F.col("name"), list(include), list(exclude)))
    return out if since_ms is None else out.where(F.col("modified_ms").isNull() | (F.col("modified_ms") >= since_ms))
