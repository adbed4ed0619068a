"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, keyed, map_arrow, stored, table, utf8

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that one table is dealt into, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 3, 2
#: A key found in more than a HOT-th of all line rows is hot; there are at most HOT such keys.
HOT = 50_000


def line_key(line: bytes) -> bytes:
    """The line without [\\x20\\x09-\\x0D] at its ends, A-Z in lower case: bytes.strip and lower know ASCII only."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def key_hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def line_rows(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(h1, h2, doc_id): the distinct long keys of each row's whole text, as two halves of a 128-bit hash."""

    def run(batches, schema):
        for b in batches:
            hashes, owners = [], []
            for k, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                if k is not None:
                    own = {key_hash(x) for x in map(line_key, t.split(b"\n")) if long_enough(x, least)}
                    hashes += own
                    owners += [k] * len(own)
            if hashes:
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield batch(schema, h[:, 0], h[:, 1], owners)

    return map_arrow(keyed(docs, key, text), run, f"h1 bigint, h2 bigint, doc_id {dict(docs.dtypes)[key]}")


class LineIndex:
    """Sorted runs of (h1, h2, n_docs, keeper), bucketed by key, in levels of like size.

    add() joins a batch of line rows against the runs: keys that no run holds are new, and the batch's
    largest id becomes their keeper; the others only add to the count. The batch becomes a run of
    level 0, and FANOUT runs of a level are merged into one run of the next. Runs and batches are
    bucketed and sorted alike, so a merge join shuffles the batch only.
    """

    def __init__(self, spark: SparkSession, kind: str, buckets: int | None = None):
        self.spark, self.kind = spark, kind
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def merged(self, names: list[str]) -> DataFrame:
        """The runs as one: a run holds a key once, so a full merge join pairs them without an exchange."""
        out = self.spark.table(names[0])
        for n in names[1:]:
            a, b = out.alias("a"), self.spark.table(n).alias("b")
            count = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
            out = a.join(b, ["h1", "h2"], "full").select("h1", "h2", count.alias("n_docs"), F.greatest("a.keeper", "b.keeper").alias("keeper"))
        return out

    def add(self, lines: DataFrame) -> None:
        """lines: (h1, h2, doc_id), a document's key once."""
        run = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        for n in self.runs():  # merge-anti-join: a key that a run holds has its keeper there
            held = self.spark.table(n).where("keeper is not null").select("h1", "h2", F.lit(True).alias("_held"))
            run = run.join(held, ["h1", "h2"], "left").select("h1", "h2", "n_docs", F.when(F.col("_held").isNull(), F.col("keeper")).alias("keeper"))
        self._push(0, self._write(run))

    def _push(self, level: int, name: str) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FANOUT:
            old = self.levels[level]
            self.levels[level] = []
            new = self._write(self.merged(old))
            self._drop(old)
            self._push(level + 1, new)

    def totals(self, least: int) -> DataFrame:
        """Keys of at least `least` documents, over all runs."""
        return self.merged(self.runs()).where(F.col("n_docs") >= least)

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []


def _free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document with its repeated lines dropped: key, kept_text, n_lines, n_dropped, and columns named in keep.

    A text is split at \\n (null or empty: one empty line). Keys of at least min_chars code points found
    in at least min_docs documents lose all their lines except in the largest key that holds them. The
    table is dealt into batches of falling ids, which a LineIndex takes one after the other, so that
    the first to hold a key is its keeper. Rows that repeat an id are one document to the counts and
    each lose the same lines; rows with a null id are counted nowhere and lose nothing. An empty table
    gives an empty result.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    bounds = docs.approxQuantile(key, [k / batches for k in range(1, batches)], 0.01)
    lines = line_rows(docs, key, text, min_chars)
    repeated = docs.groupBy(F.col(f"`{key}`")).count().where(f"`{key}` is not null and count > 1").limit(1).count()
    lines = lines.dropDuplicates() if repeated else lines
    number = sum([(F.col("doc_id") < F.lit(x)).cast("int") for x in sorted(set(bounds))], F.lit(0))
    lines = stored(lines.withColumn("batch", number))
    index = LineIndex(spark, kind)
    for k in range(len(set(bounds)) + 1):
        index.add(lines.where(F.col("batch") == k).drop("batch"))
        _free(spark)
    heavy = stored(index.totals(min_docs))
    index.close()
    # Keys that a HOT-th of all rows hold are few enough to broadcast; no other key is long in the join.
    most = max(min_docs, -(-lines.count() // HOT))
    hot, rest = heavy.where(F.col("n_docs") > most), heavy.where(F.col("n_docs") <= most)
    held = lines.drop("batch")
    drops = held.join(F.broadcast(hot.select("h1", "h2", "keeper")), ["h1", "h2"]).unionByName(held.join(rest.select("h1", "h2", "keeper"), ["h1", "h2"]))
    drops = drops.where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))
    rows = keyed(docs, key, text, *keep).join(drops.withColumnRenamed("doc_id", "_id"), F.col(f"`{key}`") == F.col("_id"), "left").drop("_id")

    def run(it, schema):
        for b in it:
            kept, total, dropped = [], [], []
            for t, d in zip(utf8(b.column(1)), b.column(len(b.schema.names) - 1).to_pylist()):
                own = t.split(b"\n")
                total.append(len(own))
                if d:
                    gone = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in d}
                    own = [x for x in own if not (long_enough(k := line_key(x), min_chars) and key_hash(k) in gone)]
                kept.append(b"\n".join(own).decode())
                dropped.append(total[-1] - len(own))
            yield batch(schema, b.column(0), kept, total, dropped, *b.columns[2:-1])

    kinds = dict(docs.dtypes)
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return map_arrow(rows, run, f"`{key}` {kind}, kept_text string, n_lines bigint, n_dropped bigint{more}")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup() over the whole of documents: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM split
), keys AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), heavy AS (
  SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keys k LEFT JOIN heavy h USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
