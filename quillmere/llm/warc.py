"""WARC archives: monolithic gzip files are inflated once and rewritten record by record, with an offset index beside them."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import discard, materialize, scratch_path

LEVEL = 1
#: Payload bytes after which a task starts another archive.
FILE_BYTES = 64 << 20
READ = 1 << 20
FIXED_DATE = "2000-01-01T00:00:00Z"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def field(value: str) -> str:
    """A header's value in which white space, control characters and % are percent-encoded, so that unquote() gives it back."""
    return "".join(quote(c, safe="") if c == "%" or c.isspace() or not c.isprintable() else c for c in value)


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but the digest and the page it repeats. White space of a url is
    percent-encoded; a null page_id has no header."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Date: {FIXED_DATE}", f"WARC-Target-URI: {''.join(quote(c) if c.isspace() or not c.isprintable() else c for c in url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {field(page_id)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {field(refers_to)}"]
    body = b"" if refers_to is not None else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


class Records:
    """Cuts a stream of inflated bytes, fed in any pieces, into whole records."""

    def __init__(self) -> None:
        self.held, self.need = bytearray(), 0

    def feed(self, data: bytes):
        self.held += data
        while True:
            if not self.need:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                head = bytes(self.held[:end])
                length = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                self.need = end + 4 + length + 4
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = 0


def inflate(source):
    """The bytes of a gzip file of one or more members, in pieces."""
    state = zlib.decompressobj(31)
    while data := source.read(READ):
        while data:
            yield state.decompress(data, 8 * READ)
            while state.unconsumed_tail:
                yield state.decompress(state.unconsumed_tail, 8 * READ)
            data = b""
            if state.eof:
                data, state = state.unused_data, zlib.decompressobj(31)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of one gzip stream each under folder; one row (path, records) per archive. pages: page_id, url, html,
    digest, refers_to. A task that is run again writes under other names; only the returned ones count."""

    def write(batches):
        fs, base = opened(folder)
        fs.create_dir(base)
        out, path, n, size, z = None, None, 0, 0, None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.mono.warc.gz", 0, 0
                    out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page_id, url or "", (html or "").encode(), digest, refers_to)
                out.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, records long")


INDEX = "path string, offset long, length long, page_id string, record_type string"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive (path): each record becomes a gzip member of its own; the sidecar <path>.idx and the
    returned rows give offset and length of each. A file is inflated once, as a stream; one record is held at a time. The
    archives are left as they are, so that a task can be run again."""

    def rewrite(batches):
        fs, base = opened(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                to, at, rows = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, []
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(to, compression=None) as out:
                    cut = Records()
                    for piece in inflate(source):
                        for data in cut.feed(piece):
                            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = z.compress(data) + z.flush()
                            out.write(member)
                            fields, _ = parse(data)
                            rows.append((to, at, len(member), fields.get("X-Page-Id"), fields["WARC-Type"]))
                            at += len(member)
                with fs.open_output_stream(to + ".idx", compression=None) as out:
                    for _, offset, length, page_id, kind in rows:
                        out.write(f"{offset} {length} {kind} {'-' if page_id is None else page_id}\n".encode())
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 10_000]), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["path", "offset", "length", "page_id", "record_type"])

    return archives.select("path").mapInArrow(rewrite, INDEX)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that index rows point at; each is
    read by its offset alone. Of a response, size and digest are taken from the payload, and must be those it states."""

    def read(batches):
        fs, _ = opened(folder)
        for batch in batches:
            rows = sorted(zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")]))
            out, path, f = [], None, None
            for p, offset, length in rows:
                if p != path:
                    path, f = p, fs.open_input_file(p)
                f.seek(offset)
                fields, body = parse(zlib.decompress(f.read(length), 31))
                size, digest, kind = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"{path} at {offset}: the payload isn't the one that was written")
                page_id, to = (None if x is None else unquote(x) for x in (fields.get("X-Page-Id"), fields.get("WARC-Refers-To-Page")))
                out.append((page_id, size, digest, kind, to))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages with digest and refers_to: the smallest page_id with an equal payload of at least `least` bytes, if it is
    another. Groups are counted before the shuffle; only payloads that occur twice are joined back. Rows repeated with
    one page_id are all of the same type; a null page_id is no page to refer to, but may refer to another."""
    body = pages.select("page_id", "url", "html", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("digest"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    first = body.where(size >= least).groupBy(F.col("digest").alias("f_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "payloads")
    joined = body.join(first, F.col("digest") == F.col("f_digest"), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files under folder and returns the index of the normalised archives.
    A null html is an empty payload, a null url an empty one; an empty table gives no archive. A record is held whole by the
    task that writes or reads it, so the longest payload bounds its memory. The monolithic archives are deleted once the whole
    index is written."""
    folder = folder or scratch_path(spark, "warc")
    cast = revisits(pages, least).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    archives = materialize(write_monolithic(cast, folder), "archives")
    n = max(1, archives.count())
    index = materialize(normalise(archives.repartition(n), folder), "warc_index")
    fs, _ = opened(folder)
    for row in archives.select("path").toLocalIterator():  # only now are all index rows kept
        fs.delete_file(row["path"])
    discard(archives)
    return index.withColumn("folder", F.lit(folder))


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """The records of archive(), read back through its index; page_id and refers_to are of the type they have in pages."""
    folder, kind = folder or scratch_path(spark, "warc"), dict(pages.dtypes)["page_id"]
    rows = read_back(archive(spark, pages, folder, least).drop("folder"), folder)
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
