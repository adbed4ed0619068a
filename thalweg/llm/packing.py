"""Bulk-synchronous best-fit packing.

Sizes are whole numbers up to the capacity, so range-sorting documents and gaps leaves runs of equal
size in which only a rank tells members apart. A superstep takes the longest documents left and sweeps
the gaps from their successor upwards: each gap of a run takes as many as fit, lowest ranks first
(so no two want one place), what is left of those gaps goes back into the order, and only when no gap
succeeds the length are new sequences opened. This is best-fit decreasing, run by run. A sweep's state
has at most one entry a size and run, whatever the number of documents; ranking the documents and
placing them by rank is what Spark distributes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, keyed, map_arrow, ranked, stored, table
from .tokens import encoder

CAPACITY, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places counts[length] documents of each length: (length, rank, n, per, sequence, offset) runs.

    Members rank to rank + n - 1 of a length go to sequences from `sequence` on, `per` to each, from
    `offset` on.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = gap // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, full * per, per, first, capacity - gap))
                rank, left = rank + full * per, left - full * per
                put(gap - per * length, first, full)
            if full < n:
                if left:
                    out.append((length, rank, left, left, first + full, capacity - gap))
                    put(gap - left * length, first + full, 1)
                    full, left = full + 1, 0
                put(gap, first + full, n - full)
    return out


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to capacity tokens; sequences are gapless from 0.

    order: columns whose hash ranks pieces of one length, and whose values break ties. Repeated rows
    are places of their own. Null or zero lengths get null places, as they take no room; longer ones
    raise an error. An empty table stays empty.
    """
    named = pieces.withColumn("_n", F.col(f"`{length}`").cast("long"))
    counts = {r[0]: r[1] for r in named.where("_n > 0").groupBy("_n").count().collect()}
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece of {max(counts)} tokens exceeds the capacity {capacity}")
    runs = sorted(sweep(counts, capacity))
    columns = [np.array(c, np.int64) for c in zip(*runs)] if runs else [np.zeros(0, np.int64)] * 6
    place = columns[0] * (1 << 40) + columns[1]
    fitted = ranked(named.where("_n > 0"), ["_n"], F.xxhash64(*[F.col(f"`{c}`") for c in order]), order)
    names = [c for c in pieces.columns]

    def run(batches, schema):
        for b in batches:
            n, rank = b.column(len(names)).to_numpy(), b.column(len(names) + 1).to_numpy()
            if not len(n):
                continue
            at = np.searchsorted(place, n * (1 << 40) + rank, "right") - 1
            behind = rank - columns[1][at]
            yield batch(schema, *b.columns[: len(names)], columns[4][at] + behind // columns[3][at], columns[5][at] + behind % columns[3][at] * n)

    ddl = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    placed = map_arrow(fitted.select(*[f"`{c}`" for c in names], "_n", "rank"), run, ddl)
    none = named.where("_n is null or _n <= 0").select(*[f"`{c}`" for c in names], F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return placed.unionByName(none)


def token_pieces(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and its end id, cut into pieces of `capacity`: key, piece, start, length, ids_crc32.

    Null text counts as empty and has the end id alone. Rows stand alone, whatever their keys.
    """

    def run(batches, schema):
        enc = encoder(path, False)
        for b in batches:
            keys, rows = b.column(0).to_pylist(), []
            for k, ids in zip(keys, enc.encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((k, piece, start, len(part), zlib.crc32(part.tobytes())))
            if rows:
                yield batch(schema, *zip(*rows))

    return map_arrow(keyed(docs, key, text), run, f"`{key}` {dict(docs.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokenizes, cuts and packs documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return pack(stored(token_pieces(docs, path)), ["doc_id", "piece", "ids_crc32"])


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the whole of documents into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
