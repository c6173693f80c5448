"""What the training-data operators share: scratch tables, word arrays, hashes and packed integer arrays."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
M1 = 0x9E3779B97F4A7C15
M2 = 0xC2B2AE3D27D4EB4F
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, a folder of this process, which only a
    local master may use: executors of other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quillmere-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quillmere/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage is cut, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more, and lets Spark drop the shuffle files of plans that are done."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def parts_of(df: DataFrame, text: str, each: int) -> int:
    """How many parts of about `each` bytes the texts of df ask for, the number of shuffle partitions at least; one pass counts them."""
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(shuffle_partitions(df.sparkSession), -(-size // each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z lower-cased, all else unchanged; the cheap form where a text has only one-byte characters."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def separated(col, separators: str):
    """The parts of a text between runs of separators, none of them empty; none where it is null. Splitting is about ten times as fast as
    extracting all matches."""
    return F.coalesce(F.array_remove(F.split(col, separators), ""), F.array().cast("array<string>"))


def n_words(col):
    """How many runs of characters other than ASCII white space a text has; none where it is null."""
    return F.size(separated(col, SPACE)).cast("long")


def binary_texts(arr: pa.Array) -> pa.Array:
    """Null texts become empty ones; the copy holds nothing before its first text, which some kernels would misread."""
    return pc.fill_null(arr.take(pa.array(np.arange(len(arr)))).cast(pa.large_string()), "")


def recoded(texts: pa.Array, change) -> pa.Array:
    """Texts (as binary_texts gives them) whose bytes, one array of all, went through `change`, which keeps their number."""
    _, offsets, data = texts.buffers()
    new = change(np.frombuffer(data, np.uint8)) if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(np.ascontiguousarray(new)))


def slices(arr: pa.Array, most: int = 4 << 20):
    """(start, length) of runs of rows with about `most` bytes of text at most, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(arr), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of all texts, the distinct words, and where each text's words start (one more than texts)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        before = np.r_[0, np.cumsum(full)]
        base = offsets[0]
        offsets = before[offsets - base]
        flat = flat.filter(pa.array(full))
    else:
        offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, offsets


def byte_list(a: pa.Array) -> list[bytes]:
    """The values as bytes, by way of numpy, which is far quicker than to_pylist()."""
    return a.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in byte_list(words)), np.uint64, len(words))


def word_hashes(texts: pa.Array, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts and where each text's words start."""
    codes, words, offsets = split_words(texts, lower)
    return (hashes(words, seed)[codes] if len(codes) else np.zeros(0, np.uint64)), offsets


def grams(h: np.ndarray, k: int, mult: int = M1) -> np.ndarray:
    """Hashes of k consecutive entries of h, by the place of the first (over the ends of texts as well)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(n, np.uint64), 1
    for i in range(k):
        out += h[i : i + n] * np.uint64(m)
        m = m * mult % 2**64
    return mixed(out)


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers as byte planes of their differences: planes of zeros cost next to nothing once compressed."""
    if not len(a):
        return b""
    d = np.empty(len(a), np.uint64)
    d[0], d[1:] = a[0], a[1:] - a[:-1]
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def parts_for(n: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(n / each))
