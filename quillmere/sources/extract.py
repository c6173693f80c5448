"""Extractors: files to markdown, chosen by extension. Each gives (kind, markdown, detail, message)."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
import uuid

import pandas as pd
from pyspark.sql import DataFrame

LEAST_PDF = 500
PANDOC = "markdown-header_attributes-link_attributes-bracketed_spans-fenced_divs"


def strip_frontmatter(text: str) -> tuple[dict[str, str], str]:
    m = re.match(r"---\r?\n(.*?)\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not m:
        return {}, text
    return {k.strip(): v.strip().strip('"') for k, _, v in (x.partition(":") for x in m[1].split("\n") if ":" in x)}, text[m.end() :]


def located(tool: str) -> str | None:
    """On the PATH, or in bin/ below the working folder."""
    return shutil.which(tool) or (p if os.access(p := os.path.join("bin", tool), os.X_OK) else None)


def markdown(path: str):
    try:
        with open(path, "rb") as f:
            text = f.read().decode("utf-8")
    except UnicodeDecodeError as e:
        return "failed", None, "not_utf8", str(e)
    except OSError as e:
        return "failed", None, "io_error", str(e)
    return "ok", strip_frontmatter(text)[1], None, None


def plain(path: str):
    try:
        with open(path, "rb") as f:
            return "ok", f.read().decode("utf-8", "replace"), None, None
    except OSError as e:
        return "failed", None, "io_error", str(e)


def by_tool(tool: str, args: list[str], path: str):
    if not (exe := located(tool)):
        return "failed", None, "no_extractor_available", f"{tool} isn't installed"
    try:
        done = subprocess.run([exe, *[a.replace("{}", path) for a in args]], capture_output=True)
    except OSError as e:
        return "failed", None, f"{tool}_spawn_failed", str(e)
    if done.returncode:
        return "failed", None, f"{tool}_failed", done.stderr.decode("utf-8", "replace")
    return "ok", done.stdout.decode("utf-8", "replace"), None, None


def pdf(path: str):
    kind, text, detail, message = by_tool("pdftotext", ["-enc", "UTF-8", "-q", "{}", "-"], path)
    if kind == "ok" and len(re.sub(r"\s", "", text)) < LEAST_PDF:
        return "needs_ocr", None, "no_extractable_text", None
    return kind, text, detail, message


def pandoc(path: str):
    kind, text, detail, message = by_tool("pandoc", ["{}", "-t", PANDOC, "--wrap=none"], path)
    return kind, re.sub(r"(?s)<span[^>]*>(.*?)</span>", r"\1", text) if kind == "ok" else None, detail, message


EXTRACTORS = {"md": markdown, "markdown": markdown, "txt": plain, "text": plain, "pdf": pdf, "docx": pandoc, "epub": pandoc}
NAMES = {markdown: "markdown", plain: "plaintext", pdf: "pdf", pandoc: "pandoc"}


def hashed(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


def extractor_name(ext: str) -> str:
    return NAMES.get(EXTRACTORS.get(ext.lower()), "unknown")


def read(known: dict, path: str, ext: str | None, full: str) -> tuple:
    """(kind, markdown, detail, message, hash of the file) of a file; one that raises fails alone."""
    f = known.get((ext or "").lower())
    try:
        return (*(f(full) if f else ("failed", None, "no_extractor_available", None)), hashed(full))
    except Exception as e:  # a broken file must not end the run
        return ("failed", None, "internal_error", repr(e), hashed(full))


def extracted(files: DataFrame, extractors=None) -> DataFrame:
    """path, kind, markdown, detail, message, hash (SHA-256 of the file, null where it can't be read) for files (path, ext, full); one
    that raises fails alone. Files must be where executors see them."""
    known = extractors or EXTRACTORS

    def run(batches):
        for b in batches:
            rows = [(path, *read(known, path, ext, full)) for path, ext, full in zip(b["path"], b["ext"], b["full"])]
            yield pd.DataFrame(rows, columns=["path", "kind", "markdown", "detail", "message", "hash"])

    return files.select("path", "ext", "full").mapInPandas(run, "path string, kind string, markdown string, detail string, message string, hash string")


STAGED = "path string, kind string, detail string, message string, staged string, out_hash string"


def staged(files: DataFrame, folder: str, extractors=None) -> DataFrame:
    """STAGED: what became of files (path, ext, full, head): tasks write head and markdown of those that succeed to files of their
    own names in folder. An attempt that dies reports nothing, so what it wrote is never looked at; it is deleted with the folder."""
    known = extractors or EXTRACTORS

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for path, ext, full, head in zip(b["path"], b["ext"], b["full"], b["head"]):
                kind, text, detail, message, _ = read(known, path, ext, full)
                at = digest = None
                if kind == "ok":
                    at, data = os.path.join(folder, uuid.uuid4().hex), (head + text).encode()
                    with open(at, "wb") as f:
                        f.write(data)
                    digest = hashlib.sha256(data).hexdigest()
                rows.append((path, kind, detail, message, at, digest))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in STAGED.split(", ")])

    return files.select("path", "ext", "full", "head").mapInPandas(run, STAGED)


def placed(files: DataFrame) -> DataFrame:
    """path, placed: whether a reported file (path, staged, target, out_hash) is at its target now. Each is renamed, which is all or
    nothing; one that an earlier attempt renamed is told by its hash, so a task can run again."""
    def run(batches):
        for b in batches:
            rows = []
            for path, at, target, digest in zip(b["path"], b["staged"], b["target"], b["out_hash"]):
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.replace(at, target)
                    rows.append((path, True))
                except FileNotFoundError:
                    rows.append((path, hashed(target) == digest))
            yield pd.DataFrame(rows, columns=["path", "placed"])

    return files.select("path", "staged", "target", "out_hash").mapInPandas(run, "path string, placed boolean")
