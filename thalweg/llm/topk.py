"""Exact top-k by inner product over a pivot-distance index.

2 q.x = |q|^2 + |x|^2 - |q - x|^2, and the triangle inequality bounds |q - x| from below by the annulus
gap | d(q, pivot) - d(x, pivot) |. The index keys each row by its nearest pivot and its distance from it,
range-sorts the rows by that key and cuts them into rings, each with its pivot, its least and largest
distance and its largest norm. A query expands the annuli whose bound reaches its floor, a score that its
k-th best is known to reach, and goes through a ring in steps outwards until the bound stops it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, keyed, map_arrow, stored, table

#: Rows that pivots are fitted on at most; pivots at least and at most; rows in one packed block of a ring.
SAMPLE, PIVOTS, BLOCK = 4096, (8, 256), 1024
#: Rings that the directory lists, about; with more blocks, neighbouring ones share a ring.
RINGS = 1 << 16
#: Rows that one range partition is planned to get; rows of a block that an annulus step takes.
PART, STEP = 16_384, 128
#: Found rows that a task holds before it merges them.
MERGE = 200_000


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) with v = floor(64 x), of the rows that take part.

    Left out: null keys, null vectors, vectors with a null or non-finite component, and vectors whose
    length is not the commonest one (the longer, if tied), as they have no inner product with the rest.
    """
    rows = keyed(vectors, key, vector).toDF("vec_id", "x").where("vec_id is not null and x is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long"), F.transform("x", lambda c: F.floor(c.cast("double") * 64).cast("double")).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def fit_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """Pivots, one for about two blocks, by k-means over at most SAMPLE rows that a hash of key and vector picks.

    Exactness does not rest on them.
    """
    h = F.xxhash64("vec_id", "v")
    some = rows.where(F.pmod(h, F.lit(max(n, 1))) < 2 * SAMPLE).orderBy(h, "vec_id", "v").limit(SAMPLE).collect()
    if not some:  # few rows and an unlucky hash
        some = rows.orderBy("vec_id", "v").limit(1).collect()
    x = np.array([r.v for r in some], np.float64)
    r = np.random.default_rng(7)
    p = x[r.permutation(len(x))[: int(np.clip(n // (2 * BLOCK), *PIVOTS))]]
    for _ in range(6):
        near = ((p * p).sum(1)[None] - 2 * x @ p.T).argmin(1)
        p = np.array([x[near == k].mean(0) if (near == k).any() else p[k] for k in range(len(p))])
    return p


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * v @ pivots.T, 0))


def _packed(v: np.ndarray) -> bytes:
    """Rows as 32-bit numbers where those are exact, else as 64-bit ones."""
    return v.astype("<f4" if not v.size or np.abs(v).max() < 1 << 24 else "<f8").tobytes()


def _unpacked(raw: bytes, n: int, pivots: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * n * pivots.shape[1] else "<f8").reshape(n, -1).astype(np.float64)


def _most(q2: np.ndarray, x2: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The largest inner product that a gap allows; the slack covers rounding."""
    most = (q2 + x2 - np.maximum(gap, 0) ** 2) / 2
    return most + 1e-6 * (1 + np.abs(most) + q2 + x2)


def build_index(rows: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    """Blocks (ring, pivot, lo, hi, x2, n, ids, dist, vectors) of every row.

    Rows are range-partitioned by pivot, distance and a hash, so that no pivot and no distance, however
    many rows have it, must fit one task; each partition is cut into blocks of one pivot and at most
    BLOCK rows. A ring is a block, or some neighbouring ones where there are more than RINGS.
    """
    share = max(1, -(-n // (BLOCK * RINGS)))

    def assign(batches, schema):
        for b in batches:
            if len(b):
                v = _matrix(b.column(1))
                d = _distances(v, pivots)
                near = d.argmin(1)
                yield batch(schema, b.column(0), near, d[np.arange(len(v)), near], [_packed(x) for x in v])

    def pack(batches, schema):
        from pyspark import TaskContext

        held: list[pa.Table] = []
        turn, size, task = 0, 0, TaskContext.get().partitionId()

        def blocks(t: pa.Table, last: bool):
            """Whole blocks, and what is left if it may go on."""
            nonlocal turn
            pivot, out, at = t["pivot"].to_numpy(), [], 0
            while at < len(t):
                end = min(at + BLOCK, at + int(np.searchsorted(pivot[at:], pivot[at], "right")))
                if end == len(t) and end - at < BLOCK and not last:
                    break
                part = t.slice(at, end - at)
                v = np.concatenate([_unpacked(x, 1, pivots) for x in part["x"].to_pylist()])
                d = part["dist"].to_numpy()
                out.append(((task << 32) + turn // share, int(pivot[at]), float(d[0]), float(d[-1]), float((v * v).sum(1).max()), len(v), part["vec_id"].to_numpy().tobytes(), d.tobytes(), _packed(v)))
                turn, at = turn + 1, end
                if end < len(t) and pivot[end] != pivot[end - 1]:
                    turn = -(-turn // share) * share  # a ring has one pivot
            return out, t.slice(at)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += len(b)
            if size >= 8 * BLOCK:
                out, rest = blocks(pa.concat_tables(held).combine_chunks(), False)
                held, size = [rest], len(rest)
                yield batch(schema, *zip(*out))
        if size:
            out, _ = blocks(pa.concat_tables(held).combine_chunks(), True)
            yield batch(schema, *zip(*out))

    dealt = map_arrow(rows, assign, "vec_id bigint, pivot int, dist double, x binary")
    dealt = dealt.repartitionByRange(max(1, -(-n // PART)), "pivot", "dist", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "dist", "vec_id")
    return map_arrow(dealt, pack, "ring bigint, pivot int, lo double, hi double, x2 double, n int, ids binary, dist binary, vectors binary")


class Directory:
    """All rings: their pivots, distances, largest squared norms and rows."""

    def __init__(self, index: DataFrame):
        t = index.groupBy("ring", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("x2").alias("x2"), F.sum("n").alias("n")).orderBy("ring").toArrow()
        self.ring, self.pivot, self.lo, self.hi, self.x2, self.n = (t[c].to_numpy() for c in ("ring", "pivot", "lo", "hi", "x2", "n"))

    def most(self, q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Bounds of the inner products of queries with the rows of each ring."""
        d = _distances(q, pivots)[:, self.pivot]
        return _most((q * q).sum(1)[:, None], self.x2[None], np.maximum(self.lo[None] - d, d - self.hi[None]))


def _dealt(queries: DataFrame, directory: Directory, pivots: np.ndarray, k: int, first: bool) -> DataFrame:
    """Blocks of queries (ring, qids, qvectors, floors) for each ring that they are to visit.

    first: each query's rings of the highest bounds, until they hold more than k rows. Otherwise: all rings
    whose bound reaches the query's floor.
    """

    def run(batches, schema):
        for b in batches:
            ids, floors = b.column(0).to_numpy(), b.column(2).to_numpy()
            v = _matrix(b.column(1))
            for at in range(0, len(ids), max(1, (1 << 22) // max(1, len(directory.ring)))):
                part = slice(at, at + max(1, (1 << 22) // max(1, len(directory.ring))))
                most = directory.most(v[part], pivots)
                if first:
                    order = np.argsort(-most, axis=1, kind="stable")
                    held = np.cumsum(directory.n[order], axis=1) - directory.n[order]
                    go = np.zeros(most.shape, bool)
                    np.put_along_axis(go, order, held <= k, 1)
                else:
                    go = most >= floors[part][:, None]
                rings = np.flatnonzero(go.any(0))
                for j in range(0, len(rings), 256):
                    own = [np.flatnonzero(go[:, r]) + at for r in rings[j : j + 256]]
                    yield batch(schema, directory.ring[rings[j : j + 256]], [ids[o].tobytes() for o in own], [_packed(v[o]) for o in own], [floors[o].tobytes() for o in own])

    return map_arrow(queries, run, "ring bigint, qids binary, qvectors binary, floors binary")


def _search(blocks: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """blocks: index blocks beside query blocks of their ring. Each task's best k: query_id, vec_id, score.

    Rows of a block are taken in steps outwards from the query's own distance; a query drops out at the
    first step whose bound stays below what its k-th best reaches. A task merges what it has found for a
    query in all its blocks, and raises its floor. A row without vec_id tells how many rows a query was
    compared with.
    """

    def run(batches, schema):
        held: list[tuple] = [(np.zeros(0, np.int64),) * 3]  # queries, ids, scores
        seen: list[tuple] = [(np.zeros(0, np.int64),) * 2]  # queries, rows compared
        least = (np.zeros(0, np.int64), np.zeros(0))  # queries with k rows, and their k-th scores

        def merge():
            nonlocal least
            q, i, s = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            held[:] = [(q[rank < k], i[rank < k], s[rank < k])]
            least = q[rank == k - 1], s[rank == k - 1]
            u, at = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
            seen[:] = [(u, np.bincount(at, weights=np.concatenate([n for _, n in seen]), minlength=len(u)).astype(np.int64))]

        size = 0
        for b in batches:
            for row in range(len(b)):
                r = {c: b.column(c)[row].as_py() for c in b.schema.names}
                ids, dist = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["dist"])
                x = _unpacked(r["vectors"], len(ids), pivots)
                qi = np.frombuffer(r["qids"], np.int64)
                q = _unpacked(r["qvectors"], len(qi), pivots)
                low, q2 = np.frombuffer(r["floors"]).copy(), (q * q).sum(1)
                if len(least[0]):
                    at = np.minimum(np.searchsorted(least[0], qi), len(least[0]) - 1)
                    low = np.where(least[0][at] == qi, np.maximum(low, least[1][at]), low)
                dq = _distances(q, pivots[r["pivot"]][None])[:, 0]
                cuts = range(0, len(ids), STEP)
                lo, hi = np.array([dist[a] for a in cuts]), np.array([dist[min(a + STEP, len(ids)) - 1] for a in cuts])
                x2 = np.array([(x[a : a + STEP] ** 2).sum(1).max() for a in cuts])
                most = _most(q2[:, None], x2[None], np.maximum(lo[None] - dq[:, None], dq[:, None] - hi[None]))
                outwards = np.argsort(-most, axis=1, kind="stable")
                got: list[list] = [[] for _ in qi]
                live, met = np.arange(len(qi)), np.zeros(len(qi), np.int64)
                for turn in range(len(lo)):
                    ring = outwards[live, turn]
                    go = most[live, ring] >= low[live]
                    live, ring = live[go], ring[go]
                    if not len(live):
                        break
                    for a in np.unique(ring):
                        own = live[ring == a]
                        part = slice(a * STEP, a * STEP + STEP)
                        s = q[own] @ x[part].T
                        s[qi[own][:, None] == ids[part][None]] = -np.inf
                        met[own] += s.shape[1]
                        hit_q, hit_x = np.nonzero((s >= low[own][:, None]) & (s > -np.inf))
                        cut = np.searchsorted(hit_q, np.arange(len(own) + 1))
                        for j in np.flatnonzero(np.diff(cut)):
                            at = hit_x[cut[j] : cut[j + 1]]
                            g = got[own[j]]
                            g.append((s[j, at], ids[part][at]))
                            if sum(len(y[0]) for y in g) >= k:
                                ss, ii = np.concatenate([y[0] for y in g]), np.concatenate([y[1] for y in g])
                                top = np.lexsort((ii, -ss))[:k]
                                g[:] = [(ss[top], ii[top])]
                                low[own[j]] = max(low[own[j]], ss[top[-1]])
                held += [(np.full(len(i), qi[j]), i, s) for j, g in enumerate(got) for s, i in g]
                seen.append((qi, met))
                size += sum(len(s) for g in got for s, _ in g)
                if size > MERGE:
                    merge()
                    size = 0
        merge()
        for c in range(0, len(held[0][0]), 1 << 16):
            yield batch(schema, *(x[c : c + (1 << 16)].astype(np.int64) for x in held[0]))
        for c in range(0, len(seen[0][0]), 1 << 16):
            part = seen[0][0][c : c + (1 << 16)]
            yield batch(schema, part, [None] * len(part), seen[0][1][c : c + (1 << 16)])

    return map_arrow(blocks, run, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best, ranked from 1; every task keeps k of a query before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.where("vec_id is not null").withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", every: int = 20, visited: bool = False) -> DataFrame:
    """Each query's k best rows by integer inner product of floor(64 x): query_id, rank, vec_id, score.

    Queries: rows whose key is divisible by `every`; candidates: every row but the query's own (rows
    that repeat its key count as its own; of a repeated key's vectors the least asks). Ties go to the
    smaller key; repeated rows under other keys each count. Rows that take no part: see quantised().
    Empty table: empty result. Components must stay below 2**22 in size after quantising, so that
    float64 sums of products stay exact. visited: also n_visited, the rows that the query was compared
    with, its first visits included. Pruning needs vectors that lie in groups; of directions spread
    evenly over many dimensions, every ring reaches every floor and all rows are compared.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, key, vector))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long" + ", n_visited long" * visited)
    pivots = fit_pivots(rows, n)
    index = stored(build_index(rows, pivots, n))
    directory = Directory(index)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "qid")
    asked = stored(asked)
    # First a query's most promising rings, which give it a floor; then every ring that its bound admits.
    first = _dealt(asked.withColumn("floor", F.lit(float("-inf"))), directory, pivots, k, True)
    near = stored(_search(index.join(first.hint("merge"), "ring"), pivots, k))
    floors = _best(near, k).groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(F.col("c") >= k)
    known = asked.join(floors, asked.qid == floors.query_id, "left").select("qid", "v", F.coalesce(F.col("s").cast("double"), F.lit(float("-inf"))).alias("floor"))
    found = _search(index.join(_dealt(known, directory, pivots, k, False).hint("merge"), "ring"), pivots, k)
    found = stored(found) if visited else found
    out = _best(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    if visited:
        out = out.join(near.unionByName(found).where("vec_id is null").groupBy("query_id").agg(F.sum("score").alias("n_visited")), "query_id")
    return out


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k over the whole of embeddings: 20 best of every row whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH parts AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
