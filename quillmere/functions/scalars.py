"""Scalar functions of the engine as Column builders: no UDF, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def extension(name) -> Column:
    """Lower-cased, without the dot; null for names without one and for dot files; empty for a name that ends in a dot."""
    n = col(name)
    return F.when(n.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(n, r"\.([^.]*)$", 1)))


def file_stem(name) -> Column:
    return F.regexp_replace(col(name), r"(?<=.)\.[^.]*$", "")


def token_estimate(text) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(col(text)) / 4).cast("int")


def sentences(text) -> Column:
    """Pieces that end after . ! or ?, trimmed; empty ones are dropped."""
    return F.filter(F.transform(F.split(col(text), r"(?<=[.!?])"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def frontmatter_body(text) -> Column:
    """What follows a leading block between --- lines; the text itself where there is none."""
    return F.regexp_replace(col(text), r"\A---\r?\n(?s:.*?)\n---[ \t]*\r?\n?", "")


def frontmatter(text) -> Column:
    """The block's key: value lines as a map of strings, trimmed of blanks and then of double quotes (of repeated keys the last); empty
    where there is none."""
    block = F.regexp_extract(col(text), r"\A---\r?\n((?s).*?)\n---[ \t]*(\r?\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda s: F.contains(s, F.lit(":")))
    entries = F.transform(lines, lambda s: F.struct(F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.trim(F.regexp_replace(s, r"^[^:]*:", "")), F.lit('"')).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


def strip_spans(text) -> Column:
    """The contents of <span ...>x</span>; the first end tag closes."""
    return F.regexp_replace(col(text), r"(?s)<span[^>]*>(.*?)</span>", "$1")


def output_path(path, collision_aware: bool = True) -> Column:
    """Where a source's markdown goes: its own name with .md added, or in place of its extension."""
    p = col(path)
    return F.concat(p, F.lit(".md")) if collision_aware else F.concat(F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", ""), F.lit(".md"))


def annotation(source, source_hash, extractor, at_ms) -> Column:
    """The comment line that names a converted file's source."""
    def clean(c):
        out = F.replace(F.replace(F.replace(col(c), F.lit(" "), F.lit("%20")), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0a"))
        return F.replace(out, F.lit("-->"), F.lit("--&gt;"))

    return F.concat(F.lit("<!-- md: source="), clean(source), F.lit(" hash="), F.left(col(source_hash), F.lit(12)), F.lit(" extractor="), clean(extractor), F.lit(" at="), col(at_ms).cast("string"), F.lit(" -->"))


def annotated_source(text) -> Column:
    """The source that the first line's comment names, as written there; null where there is none."""
    line = F.split_part(col(text), F.lit("\n"), F.lit(1))
    raw = F.regexp_extract(line, r"^<!-- md:(?:.*\s)?source=(\S*)(?:\s.*)?-->$", 1)
    return F.when(F.length(raw) > 0, raw)


def sanitized_source(name) -> Column:
    return F.regexp_replace(col(name), r"[^\p{L}\p{N}\-_. ]", "_")


def csv_escaped(c) -> Column:
    x = col(c).cast("string")
    return F.when(x.rlike("[,\"\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def needs_ocr(text, least: int = 500) -> Column:
    return F.length(F.regexp_replace(col(text), r"(?U)\s", "")) < least


def iso_ms(text) -> Column:
    return F.unix_millis(F.try_to_timestamp(col(text)))


def server_path(url) -> Column:
    """The path of a url, without query or fragment."""
    return F.regexp_extract(col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def base64url(c) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(col(c), "UTF-8")), "+/=", "-_ "))


def human_size(size) -> Column:
    s = col(size).cast("double")
    out = F.when(s.isNull(), F.lit("-")).when(s < 1024, F.concat(s.cast("long").cast("string"), F.lit("B")))
    for i, unit in enumerate(("K", "M", "G"), 1):
        out = out.when(s < 1024.0 ** (i + 1), F.concat(F.format_string("%.1f", s / 1024.0**i), F.lit(unit)))
    return out.otherwise(F.concat(F.format_string("%.1f", s / 1024.0**4), F.lit("T")))


def truncated(text, most: int) -> Column:
    return F.when(F.char_length(col(text)) <= most, col(text)).otherwise(F.concat(F.left(col(text), F.lit(most - 1)), F.lit("\u2026")))


def time_text(ms) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd HH:mm"), F.lit("never"))


def preview(text) -> Column:
    return F.left(col(text), F.lit(200))


def share_parts(uri) -> tuple[Column, Column]:
    """(host, share) of a UNC path or an smb, cifs or nfs url."""
    p = F.regexp_replace(F.replace(col(uri), F.lit("\\"), F.lit("/")), r"^(?:smb:|cifs:|nfs:)?/*", "")
    parts = F.filter(F.split(p, "/"), lambda x: F.length(x) > 0)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def doc_changed(size, old_size, mtime, old_mtime, new_hash, old_hash, old_status) -> Column:
    """Whether an item differs from its registry row: size, time, a hash where one was taken, or a row that was gone."""
    s, t, h = (~col(a).eqNullSafe(col(b)) for a, b in ((size, old_size), (mtime, old_mtime), (new_hash, old_hash)))
    return s | t | (col(new_hash).isNotNull() & h) | (col(old_status) == "gone")
