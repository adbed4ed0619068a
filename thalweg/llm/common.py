"""What several operators share: tables, shared folders, bytes-level words, skew-free ranks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes, in one Arrow batch: long texts make larger batches too heavy for a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, with Arrow batches kept small for whatever Python reads it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, in this order, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local folder is made only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_thalweg_dir", None) or tempfile.mkdtemp(prefix="thalweg-")
        spark._thalweg_dir = base
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/thalweg-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def release(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir named."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_all() -> None:
    for spark, path in _written:
        try:
            release(spark, path)
        except Exception:  # the session has ended and nothing can be deleted through it
            return


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and cuts at [\\x20\\x09-\\x0D]+; bytes.lower and bytes.split know ASCII only."""
    return text.lower().split()


def id_text_crc(doc_id: int | None) -> int:
    """crc32 of a doc_id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def map_arrow(df: DataFrame, fn, ddl: str) -> DataFrame:
    """fn(batches, schema) -> batches, over df; schema is ddl as Arrow's."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batches, schema)

    return df.mapInArrow(run, ddl)


def ranked(df: DataFrame, keys: list[str], order: Column, ties: list[str], salts: int = 64) -> DataFrame:
    """Adds rank (from 0) within keys by a hash order, without ever sorting one key in one task.

    order: a 64-bit hash. Its top bits deal each key over `salts` buckets, which are ranked apart
    and then shifted by the counts of the buckets before them. ties: columns that order equal hashes.
    """
    from pyspark.sql import Window

    width = 64 - (salts - 1).bit_length()
    out = df.withColumn("_h", order).withColumn("_b", F.shiftrightunsigned("_h", width).cast("int"))
    counts = out.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *ties)) - 1
    left, on = out.withColumn("_r", within).alias("l"), F.lit(True)
    for k in [*keys, "_b"]:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(counts.alias("r"), on).select("l.*", (F.col("_before") + F.col("_r")).cast("long").alias("rank")).drop("_h", "_b", "_r")


def hash64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        for k, base in enumerate((_ROOT, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _hashed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in bytes: a polynomial modulo 2**64, taken between word ends from one
    running sum, then mixed."""
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(b) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(b) and not space[-1]:
        edge = np.append(edge, len(b))
    start, stop = edge[::2], edge[1::2]
    power, inverse = _power(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b.astype(np.uint64) * power[: len(b)], dtype=np.uint64, out=total[1:])
        return hash64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)), start


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of words(text), without a Python object per word."""
    return _hashed(np.frombuffer(text.lower(), np.uint8))[0]


def many_word_hashes(texts: list[bytes], block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of many texts at once, and the number of words of each text.

    Texts are joined by white space and worked off in blocks of about `block` bytes, cut at white space, so
    that memory follows the block (or the longest word, if that is longer) and not the texts.
    """
    joined = b"\n".join(texts).lower()
    ends = np.cumsum([len(t) + 1 for t in texts])
    found, starts, at = [], [], 0
    while at < len(joined):
        end = at + block
        if end < len(joined):
            cut = _SPACE.search(joined, end)
            end = cut.start() if cut else len(joined)
        h, start = _hashed(np.frombuffer(joined, np.uint8, min(end, len(joined)) - at, at))
        found.append(h)
        starts.append(start + at)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


class HashTable:
    """Places of known 64-bit hashes, found by numpy: direct-mapped levels, the commonest in the first."""

    def __init__(self, hashes: np.ndarray, levels: int = 3):
        self.none, self.levels, left = len(hashes), [], np.arange(len(hashes))
        bits = max(4, (2 * len(hashes)).bit_length())
        for k in range(levels):
            slot = self._slot(hashes[left], bits, k)
            _, first = np.unique(slot, return_index=True)
            held, place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.none, np.int32)
            held[slot[first]], place[slot[first]] = hashes[left[first]], left[first]
            self.levels.append((bits, held, place))
            left = np.delete(left, first)
        order = np.argsort(hashes[left])
        self.rest, self.rest_place = hashes[left][order], left[order].astype(np.int32)

    @staticmethod
    def _slot(h: np.ndarray, bits: int, level: int) -> np.ndarray:
        return (h >> np.uint64(64 - bits - 7 * level) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash; the number of known ones for those that aren't known."""
        out, left = np.full(len(h), self.none, np.int32), None
        for k, (bits, held, place) in enumerate(self.levels):
            own = h if left is None else h[left]
            slot = self._slot(own, bits, k)
            hit = (held[slot] == own) & (place[slot] < self.none)
            if left is None:
                out[hit] = place[slot[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = place[slot[hit]]
                left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, h[left]), len(self.rest) - 1)
            hit = self.rest[at] == h[left]
            out[left[hit]] = self.rest_place[at[hit]]
        return out


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; fewer words than width: the whole sequence as one."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(width, len(w))
    with np.errstate(over="ignore"):
        out = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            out = hash64(out * np.uint64(0xD1342543DE82EF95) + w[k : len(w) - n + k + 1])
    return np.unique(out)
