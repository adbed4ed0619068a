"""Token-id shards with a minimal perfect hash index from document keys to offsets.

A shard file, little-endian:
  magic "TWIDS01\\n"; the raw uint32 ids of its documents, in order; the index; a footer.
Index: bit arrays of the hash levels (uint64 words), the number of set bits before each word (uint32),
keys that no level separated (three uint64: two hashes, slot), and for each slot a stored fingerprint
(uint32), the first id's position (uint64) and the number of ids (uint32).
Footer: ten uint64: version, payload ids, documents, levels, words, rest keys, end id, index position,
seed, crc32 of the index; then the level sizes in bits (uint64 each, 40 places); then the magic.

A key is looked up in constant time: its first level with a set bit gives the bit's rank, which is its
slot; the fingerprint then tells whether the key is in the shard at all.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, hash64, keyed, map_arrow, shared_dir, stored, table
from .tokens import encoder

MAGIC, LEVELS, GAMMA = b"TWIDS01\n", 40, 2.0
TOKENIZER, END = "byte_bpe_50k.json", 2
FOOTER = 10 * 8 + LEVELS * 8 + len(MAGIC)


def key_hashes(keys: list, repeats: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each key; repeats tells apart documents of one key."""
    import xxhash

    both = [xxhash.xxh3_128_intdigest(f"{'' if k is None else type(k).__name__}:{k}:{r}") for k, r in zip(keys, repeats)]
    mask = (1 << 64) - 1
    return np.array([x & mask for x in both], np.uint64), np.array([x >> 64 for x in both], np.uint64)


def _place(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hash64(a + np.uint64(level) * b) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Maps n distinct keys onto 0 to n - 1: in each level, a key alone at its bit sets it; the others go on."""

    def __init__(self, sizes: list[int], words: np.ndarray, before: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.before, self.rest = sizes, words, before, rest
        self.first = np.concatenate(([0], np.cumsum([s // 64 for s in sizes]))).astype(np.int64)
        self.slots = {(int(x), int(y)): int(z) for x, y, z in rest}

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "PerfectHash":
        left, sizes, words = np.arange(len(a)), [], []
        while len(left) and len(sizes) < LEVELS:
            bits = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _place(a[left], b[left], len(sizes) + 1, bits)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = left[~alone[at]]
        words = np.concatenate(words) if words else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        before = (np.cumsum(counts) - counts).astype("<u4")
        rest = np.stack([a[left], b[left], np.arange(len(left), dtype=np.uint64) + np.uint64(counts.sum())], 1) if len(left) else np.zeros((0, 3), np.uint64)
        return cls(sizes, words, before, rest)

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where no level knows the key."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(a[left], b[left], level + 1, bits)
            word, bit = self.first[level] + at // 64, (at % 64).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            w, k = word[hit], bit[hit]
            out[left[hit]] = self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & ((np.uint64(1) << k) - np.uint64(1)))
            left = left[~hit]
        for i in left if self.slots else ():
            out[i] = self.slots.get((int(a[i]), int(b[i])), -1)
        return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams ids into a new file; the file gets its name only when it is complete."""

    def __init__(self, uri: str, end: int, width: int = 4):
        self.uri, self.end, self.width = uri, end, width
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.out.write(MAGIC)
        self.keys: list = []
        self.repeats: list[int] = []
        self.lengths: list[np.ndarray] = []

    def add(self, keys: list, ids: list[np.ndarray]) -> None:
        """Documents in order; documents of one key must follow each other."""
        for k in keys:
            self.repeats.append(self.repeats[-1] + 1 if self.keys and self.keys[-1] == k else 0)
            self.keys.append(k)
        self.lengths.append(np.array([len(x) for x in ids], np.int64))
        self.out.write(b"".join(x.astype(f"<u{self.width}").tobytes() for x in ids))

    def close(self) -> tuple[int, int]:
        lengths = np.concatenate(self.lengths)
        starts = np.cumsum(lengths) - lengths
        a, b = key_hashes(self.keys, self.repeats)
        mph = PerfectHash.build(a, b)
        slot = mph.slot(a, b)
        n, total = len(lengths), int(lengths.sum())
        prints, first, count = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
        prints[slot], first[slot], count[slot] = (b & np.uint64(0xFFFFFFFF)), starts, lengths
        index = b"".join(x.tobytes() for x in (mph.words, mph.before, mph.rest.astype("<u8"), prints, first, count))
        sizes = mph.sizes + [0] * (LEVELS - len(mph.sizes))
        footer = struct.pack(f"<{10 + LEVELS}Q", 1, total, n, len(mph.sizes), len(mph.words), len(mph.rest), self.end, len(MAGIC) + self.width * total, self.width, zlib.crc32(index), *sizes)
        self.out.write(index + footer + MAGIC)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return n, total


class Shard:
    """Keyed access to a shard file: the index is read once, ids by position."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        tail = self.file.read_at(FOOTER, size - FOOTER)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} is no token-id shard")
        self.version, self.n_ids, self.n, levels, words, rest, self.end, at, self.width, crc, *sizes = struct.unpack(f"<{10 + LEVELS}Q", tail[: -len(MAGIC)])
        index = self.file.read_at(size - FOOTER - at, at)
        if zlib.crc32(index) != crc:
            raise ValueError(f"{uri}: its index is damaged")
        parts, k = [], 0
        for kind, count in (("<u8", words), ("<u4", words), ("<u8", 3 * rest), ("<u4", self.n), ("<u8", self.n), ("<u4", self.n)):
            parts.append(np.frombuffer(index, kind, count, k))
            k += count * np.dtype(kind).itemsize
        self.mph = PerfectHash(list(sizes[:levels]), parts[0], parts[1], parts[2].reshape(-1, 3))
        self.prints, self.first, self.count = parts[3:]

    def find(self, keys: list, repeats: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First id's position (-1 if the key isn't there) and number of ids of each key."""
        a, b = key_hashes(keys, repeats or [0] * len(keys))
        slot = self.mph.slot(a, b)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == (b[ok] & np.uint64(0xFFFFFFFF))
        slot = np.where(ok, slot, 0)
        return np.where(ok, self.first[slot].astype(np.int64), -1), np.where(ok, self.count[slot].astype(np.int64), 0)

    def ids(self, first: int, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.width * count, len(MAGIC) + self.width * first), f"<u{self.width}").astype("<u4")


def write_shards(docs: DataFrame, folder: str, path: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, range-sorts by key (nulls first) and writes a shard for each range; returns the stored manifest.

    Manifest: shard, uri, n, n_ids, base (ids in the shards before it), and keys with their repeats
    for full reads. Null text counts as empty; documents of one key stay together, ordered by text.
    A repeated task writes a file of its own name, and only the manifest's rows count, so lost
    executors leave no half files behind that anything would read.
    """
    kind = dict(docs.dtypes)[key]
    rows = keyed(docs, key, text).toDF("k", "t").repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(batches, schema):
        task, writer, enc = TaskContext.get(), None, encoder(path, True)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                if len(part):
                    writer = writer or ShardWriter(uri, end, width)
                    ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                    writer.add(part.column(0).to_pylist(), [np.append(x, np.uint32(end)) for x in ids])
        if writer:
            n, total = writer.close()
            yield batch(schema, [task.partitionId()], [uri], [n], [total], [writer.keys], [writer.repeats])

    manifest = stored(map_arrow(rows, run, f"shard int, uri string, n bigint, n_ids bigint, keys array<{kind}>, repeats array<int>"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.select("shard", "n_ids").withColumn("base", F.coalesce(before, F.lit(0))).drop("n_ids")
    return manifest.join(bases, "shard")


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Looks up every key of the manifest in its shard file: key, start, n_tokens, ids_crc32.

    The manifest is small beside its files, so the number of tasks is stated: one for each shard.
    """
    kind, shards = dict(manifest.dtypes)["keys"][6:-1], max(1, manifest.count())

    def run(batches, schema):
        for b in batches:
            for r in b.to_pylist():
                shard = Shard(r["uri"])
                for k in range(0, len(r["keys"]), 4096):
                    keys, repeats = r["keys"][k : k + 4096], r["repeats"][k : k + 4096]
                    first, count = shard.find(keys, repeats)
                    if (first < 0).any():
                        raise ValueError(f"{r['uri']} lacks a key of its manifest")
                    crc = []
                    for j in range(0, len(keys), 256):
                        lo, hi = int(first[j : j + 256].min()), int((first + count)[j : j + 256].max())
                        ids = shard.ids(lo, hi - lo)
                        crc += [zlib.crc32(ids[f - lo : f - lo + c].tobytes()) for f, c in zip(first[j : j + 256], count[j : j + 256])]
                    yield batch(schema, pa.array(keys, schema.field(0).type), first + r["base"], count, crc)

    return map_arrow(manifest.select("uri", "base", "keys", "repeats").repartition(shards, "uri"), run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of the whole of documents to shard files and reads them back through their indexes."""
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), shared_dir(spark), public_tokenizers.path(TOKENIZER)))
