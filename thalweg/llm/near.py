"""Similarity join of documents by Jaccard of word shingles, and its connected classes.

Sets that are equal become one. A shuffle of packed shingle hashes tells each document which of its
shingles others hold too and how often; nothing but those can be shared. In the order of rising
frequency, two linked documents share at least two of the first n - ceil(t n) + 2 shingles of either
(the prefix extended by one). A prefix shingle of a rare class is a signature by itself; those of
the frequent class are indexed in pairs, as two shared ones are either partly rare or a pair of frequent
ones; very long sets, which link with long ones only, take singles throughout. Documents that share a signature, directly or through others, are candidates for one
class, within which intersections are counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch, hash64, keyed, map_arrow, release, shared_dir, shingles, stored, table, utf8
from .graph import components

#: Shingles held by at most RARE documents are signatures by themselves.
RARE = 32
#: Shingles that one task gathers before it deals them out, and that one reducer is planned to get.
FLUSH, REDUCER = 2_000_000, 2_500_000
#: Sets held by more than a HOT-th of all documents are told to every task: at most HOT of them.
HOT = 20_000
#: A shingle that a COMMON-th of all documents hold, by the counts of tasks in which a COMMON-th hold it, is common.
COMMON = 100
#: Sets of so many shingles take single signatures only, as pairs of all their frequent shingles are many.
LONG = 4_000
#: Candidate classes of more documents, or more shingles, are worked off in rounds by many tasks.
CLASS_DOCS, CLASS_SHINGLES = 8_000, 4_000_000
#: Documents that one task of such a round compares, and documents that they are compared with in each round.
CHUNK, LEADERS = 2_000, 48
#: Large classes, of a few numbers each, that are told to every task at most.
TOLD = 1 << 20


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), xxhash.xxh64_intdigest(s.tobytes(), 9) - (1 << 63)


def smallest(percent: int) -> int:
    """The least set size that can link with a set other than its equal."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix, extended by one, for a set of n shingles."""
    return n - -(-percent * n // 100) + 2


def document_sets(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): size and hash of each whole text's set; n_shingles is 0 without words.

    Rows with n_shingles -1 tell of shingles (k1) that many documents of one task hold, and how many (k2).
    """

    def run(batches, schema):
        held, size = [], 0

        def often():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            many = c > max(RARE, len(held) // COMMON)
            n = int(many.sum())
            return batch(schema, [None] * n, [-1] * n, h[many].view(np.int64), c[many])

        for b in batches:
            rows = []
            for t in utf8(b.column(1)):
                s = shingles(t, width)
                rows.append((len(s), *(set_hashes(s) if len(s) else (None, None))))
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield often()
                    held, size = [], 0
            if rows:
                yield batch(schema, b.column(0), *zip(*rows))
        if held:
            yield often()

    return map_arrow(keyed(docs, key, text), run, f"doc_id {dict(docs.dtypes)[key]}, n_shingles bigint, k1 bigint, k2 bigint")


def common_shingles(sets: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common shingles in ascending order, and about how many documents hold each.

    At most COMMON times the mean size of a set. All that two COMMON-ths of all documents hold are among them.
    Which are, and how exact their numbers are, changes the order of prefixes alone, in which all agree.
    """
    found = sets.where("n_shingles = -1").groupBy("k1").agg(F.sum("k2").alias("c")).where(F.col("c") > max(RARE, rows // COMMON)).toArrow()
    h, c = found["k1"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(h)
    return h[order], np.minimum(c[order], (1 << 32) - 1)


def _dealt(docs: DataFrame, width: int, percent: int, parts: int, hot: dict, often: tuple, key: str, text: str) -> DataFrame:
    """Packed postings: (part, src, body, n) and, under negative parts, the documents of each src.

    A shingle's part comes from the high half of its hash; 40 bits of the rest tell it from others there.
    Common shingles are dealt to no part: each src has its own, with the frequencies that all know, under
    a negative part and with a negative n. src numbers what a task gathered; tasks read their file splits
    in a fixed order, so a repeated task deals out the same.
    """
    least, (known, times) = smallest(percent), often

    def run(batches, schema):
        task, turn = TaskContext.get().partitionId(), 0
        ids: list = []
        sets: list[np.ndarray] = []

        def flush():
            nonlocal turn
            src = task * 1_000_000 + turn
            turn += 1
            sizes = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate(sets)
            index = np.repeat(np.arange(len(sets), dtype="<u4"), sizes)
            out = [(-1 - src % parts, src, np.array(ids, "<i8").tobytes() + sizes.astype("<i8").tobytes(), len(ids))]
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                own = known[at] == h
                if own.any():
                    body = (at[own] | 1 << 62).astype("<i8").tobytes() + times[at[own]].astype("<u4").tobytes() + index[own].astype("<u2").tobytes()
                    out.append((-1 - src % parts, src, body, -int(own.sum())))
                    h, index = h[~own], index[~own]
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            low = h & np.uint64((1 << 40) - 1)
            order = np.argsort(part, kind="stable")
            index, low, cut = index[order], low[order], np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                a, b = cut[p], cut[p + 1]
                if a < b:
                    raw = low[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    out.append((p, src, raw + index[a:b].astype("<u2").tobytes(), int(b - a)))
            ids.clear()
            sets.clear()
            for k in range(0, len(out), 64):
                yield batch(schema, *zip(*out[k : k + 64]))

        held = 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                if k is None:
                    continue
                s = shingles(t, width)
                if len(s) < least or hot.get(set_hashes(s), k) != k:
                    continue
                ids.append(k)
                sets.append(s)
                held += len(s)
                if held >= FLUSH or len(ids) == 65_000:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return map_arrow(keyed(docs, key, text), run, "part int, src bigint, body binary, n bigint")


def _postings(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.zeros((n, 8), np.uint8)
    low[:, :5] = np.frombuffer(body, np.uint8, 5 * n).reshape(n, 5)
    return low.view("<u8")[:, 0], np.frombuffer(body, "<u2", n, 5 * n)


def _shared(dealt: DataFrame) -> DataFrame:
    """Of each part, what occurs more than once, back to its src: (src, n, body of tokens, frequencies, indexes).

    Negative parts pass through as rows of their src, with first set for documents.
    """
    ddl = "src bigint, n bigint, body binary, first boolean"
    schema = arrow_schema(ddl)

    def run(key, t):
        part = key[0].as_py()
        if part < 0:
            n = t["n"].to_numpy()
            return pa.Table.from_batches([batch(schema, t["src"].to_pylist(), np.abs(n), t["body"].to_pylist(), n >= 0)])
        srcs, ns, bodies = t["src"].to_pylist(), t["n"].to_pylist(), t["body"].to_pylist()
        order = np.argsort(srcs, kind="stable")
        total = int(sum(ns))
        low, index, src = np.empty(total, "<u8"), np.empty(total, "<u2"), np.empty(total, np.int32)
        at = 0
        for j, o in enumerate(order):
            n = ns[o]
            low[at : at + n], index[at : at + n] = _postings(bodies[o], n)
            src[at : at + n] = j
            at += n
        by = np.argsort(low, kind="stable")
        run_start = np.flatnonzero(np.concatenate(([True], np.diff(low[by]) != 0)))
        counts = np.diff(np.append(run_start, total))
        df = np.repeat(counts, counts)
        some = by[df > 1]
        freq = df[df > 1]
        back = np.argsort(some, kind="stable")
        some, freq = some[back], freq[back]
        token = (low[some] | np.uint64(part) << np.uint64(40)).astype("<i8")
        rows = []
        cut = np.searchsorted(src[some], np.arange(len(order) + 1))
        for j, o in enumerate(order):
            a, b = cut[j], cut[j + 1]
            if a < b:
                rows.append((srcs[o], int(b - a), token[a:b].tobytes() + freq[a:b].astype("<u4").tobytes() + index[some[a:b]].tobytes(), False))
        return pa.Table.from_batches([batch(schema, *zip(*rows))] if rows else [], schema)

    return dealt.groupBy("part").applyInArrow(run, ddl)


def _candidates(shared: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, tokens, sigs) of documents whose extended prefix holds shared shingles."""
    ddl = "doc_id bigint, n bigint, tokens binary, sigs array<bigint>"
    schema = arrow_schema(ddl)

    def run(t: pa.Table) -> pa.Table:
        hit_t, hit_f, hit_i, ids, sizes = [], [], [], None, None
        for n, body, first in zip(t["n"].to_pylist(), t["body"].to_pylist(), t["first"].to_pylist()):
            if first:
                both = np.frombuffer(body, "<i8")
                ids, sizes = both[:n], both[n:]
            else:
                hit_t.append(np.frombuffer(body, "<i8", n))
                hit_f.append(np.frombuffer(body, "<u4", n, 8 * n))
                hit_i.append(np.frombuffer(body, "<u2", n, 12 * n))
        rows = []
        if hit_t:
            tok, freq, index = np.concatenate(hit_t), np.concatenate(hit_f).astype(np.int64), np.concatenate(hit_i).astype(np.int64)
            held = np.bincount(index, minlength=len(ids))
            room = prefix(sizes, percent) - (sizes - held)
            ok = (room > 0)[index]
            tok, freq, index = tok[ok], freq[ok], index[ok]
            order = np.lexsort((tok, freq, index))
            tok, freq, index = tok[order], freq[order], index[order]
            cut = np.searchsorted(index, np.arange(len(ids) + 1))
            for j in np.flatnonzero(np.diff(cut)):
                a, b = cut[j], cut[j + 1]
                t_, f_ = tok[a:b], freq[a:b]
                r = min(int(room[j]), b - a)
                while r < b - a and f_[r] == f_[r - 1] and t_[r] == t_[r - 1]:
                    r += 1
                p, at = np.unique(t_[:r], return_index=True)
                p, f = p.astype(np.uint64), f_[at]
                # a set of LONG or more links with none below LONG * percent / 100: from there on all are singles
                n = int(sizes[j])
                rare = f <= RARE if 100 * n < percent * LONG else np.ones(len(p), bool)
                sigs, often = [hash64(p[rare])], hash64(p[f > RARE]) if n < LONG else p[:0]
                for k in range(len(often) - 1):
                    with np.errstate(over="ignore"):
                        x, y = np.minimum(often[k], often[k + 1 :]), np.maximum(often[k], often[k + 1 :])
                        sigs.append(hash64(x * np.uint64(0x9E3779B97F4A7C15) + y))
                sigs = np.concatenate(sigs).view(np.int64)
                if len(sigs):
                    rows.append((int(ids[j]), n, np.unique(t_).tobytes(), sigs))
        out = []
        for k in range(0, len(rows), 512):
            i, n, tk, sg = zip(*rows[k : k + 512])
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sg)]).astype(np.int32), pa.array(np.concatenate(sg)))
            out.append(pa.RecordBatch.from_arrays([pa.array(i), pa.array(n), pa.array(tk, pa.binary()), lists.cast(schema.field(3).type)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return shared.groupBy("src").applyInArrow(run, ddl)


class _Group:
    """Exact intersections of one document with all of a group, by counting over postings."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray]):
        self.sizes, lens = sizes, np.array([len(x) for x in tokens], np.int64)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(tokens)), lens)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order].astype(np.int32)
        self.first = np.flatnonzero(np.concatenate(([True], np.diff(flat) != 0))) if len(flat) else np.zeros(0, np.int64)
        self.ends = np.append(self.first[1:], len(flat)) if len(flat) else self.first
        self.values = flat[self.first]

    def links(self, size: int, tokens: np.ndarray, percent: int) -> np.ndarray:
        known = np.intersect1d(tokens, self.values, assume_unique=True)
        if not len(known):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.values, known)
        hit = np.concatenate([self.owner[a:b] for a, b in zip(self.first[at], self.ends[at])])
        both = np.bincount(hit, minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (size + self.sizes - both))


def _forest(n: int) -> tuple:
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, others: np.ndarray) -> None:
        r = find(i)
        for j in others:
            s = find(int(j))
            if s != r:
                root[s] = r

    return find, join


def _classes(percent: int):
    """Kernel for a candidate class that one task holds: exact links as a star to each class's least member.

    Members are taken as leaders, those of the commonest shingles first, and compared with all. A pair
    is left out only if both are in the largest class at the end, where a link adds nothing.
    """
    schema = arrow_schema("a bigint, b bigint")

    def run(t: pa.Table) -> pa.Table:
        ids, sizes = t["doc_id"].to_numpy(), t["n"].to_numpy()
        tokens = [np.frombuffer(x, "<i8") for x in t["tokens"].to_pylist()]
        group = _Group(sizes, tokens)
        find, join = _forest(len(ids))
        spread = group.ends - group.first
        weight = [float(spread[np.searchsorted(group.values, x)].mean()) if len(x) else 0.0 for x in tokens]
        done = np.zeros(len(ids), bool)
        order = np.argsort(weight)[::-1]
        while True:
            label = np.array([find(k) for k in range(len(ids))])
            values, counts = np.unique(label, return_counts=True)
            # judged anew each time: whoever was in a class that is no longer the largest is open again
            left = order[~done[order] & (label[order] != values[counts.argmax()])]
            if not len(left):
                break
            for i in left[:16]:
                join(int(i), group.links(int(sizes[i]), tokens[i], percent))
                done[i] = True
        least = {}
        for k, r in zip(ids, label):
            least[r] = min(least.get(r, k), k)
        rows = [(int(k), int(least[r])) for k, r in zip(ids, label) if least[r] != k]
        return pa.Table.from_batches([batch(schema, *zip(*rows))] if rows else [], schema)

    return run


def _told(classes: DataFrame) -> DataFrame:
    """A row for each large class, broadcast up to TOLD of them: a join by class would shuffle it into one task first."""
    return F.broadcast(classes) if classes.count() <= TOLD else classes


def _rounds(large: DataFrame, percent: int) -> DataFrame | None:
    """Links of candidate classes too large for one task: (a, b).

    Each round compares some open members of each class, the leaders, with all its members, in chunks
    over many tasks. A leader has all its links after its round; members of the largest class found
    need none among themselves. Open are all that are neither, as of the last round; rounds end when
    none is. The number of leaders doubles with each round.
    """
    ddl = "a bigint, b bigint"
    schema, spark = arrow_schema(ddl), large.sparkSession
    paths: dict[str, str] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        """stored() in place of what had the name before, which goes."""
        path = shared_dir(spark)
        out = stored(df, path)
        if name in paths:
            release(spark, paths[name])
        paths[name] = path
        return out

    large = keep("large", large)
    sizes = _told(large.groupBy("comp").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")))
    if not large.limit(1).count():
        return None
    members = keep("members", large.join(sizes, "comp").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "chunks")).drop("chunks"))
    open_, links, led, leaders_n = members.select("comp", "doc_id"), None, None, LEADERS
    chunks_of = members.select(F.col("comp").alias("class"), F.col("salt").alias("chunk")).distinct()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, lead = left["doc_id"].to_numpy(), right["lead"].to_numpy()
        if not len(ids) or not len(lead):
            return pa.Table.from_batches([], schema)
        group = _Group(left["n"].to_numpy(), [np.frombuffer(x, "<i8") for x in left["tokens"].to_pylist()])
        find, join = _forest(len(ids) + len(lead))
        rows = []
        for j, (n, tk) in enumerate(zip(right["size"].to_pylist(), right["own"].to_pylist())):
            for i in group.links(n, np.frombuffer(tk, "<i8"), percent):
                if ids[i] != lead[j] and find(int(i)) != find(len(ids) + j):
                    join(len(ids) + j, np.array([i]))
                    rows.append((int(ids[i]), int(lead[j])))
        return pa.Table.from_batches([batch(schema, *zip(*rows))] if rows else [], schema)

    while True:
        counts = _told(open_.groupBy("comp").agg(F.count("*").alias("c")))
        picked = open_.join(counts, "comp").where(F.pmod(F.xxhash64("doc_id", F.lit(leaders_n)), F.col("c")) < leaders_n).select("comp", "doc_id")
        # a class whose hash picked none still goes on by its least open member
        picked = keep("picked", picked.unionByName(open_.groupBy("comp").agg(F.min("doc_id").alias("doc_id"))).distinct())
        leaders = picked.join(members.select("doc_id", "n", "tokens"), "doc_id")
        spread = leaders.select(F.col("comp").alias("class"), F.col("doc_id").alias("lead"), F.col("n").alias("size"), F.col("tokens").alias("own")).join(chunks_of, "class")
        found = members.groupBy("comp", "salt").cogroup(spread.groupBy("class", "chunk")).applyInArrow(compare, ddl)
        links = keep("links", found if links is None else links.unionByName(found))
        labels = members.select("comp", "doc_id").join(components(links), F.col("doc_id") == F.col("node"), "left").select("comp", "doc_id", F.coalesce("component", "doc_id").alias("label"))
        tally = labels.groupBy("comp", "label").count()
        biggest = _told(keep("biggest", tally.groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("top"))))
        led = keep("led", picked if led is None else led.unionByName(picked))
        # from all members: those of a former largest class are open again
        left = labels.join(biggest, "comp").where("label <> top").select("comp", "doc_id").distinct()
        open_ = keep("open", left.join(led, ["comp", "doc_id"], "left_anti"))
        if not open_.limit(1).count():
            for name in ("large", "members", "picked", "led", "open", "biggest"):
                release(spark, paths[name])
            return links
        leaders_n *= 2


def similar_classes(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the least doc_id that links reach, itself included.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; equal sets
    that aren't empty always do. Null, empty or blank texts have empty sets and link with nothing. Rows with a
    null id take no part and have a null component. Rows that repeat an id are one document, linked by
    any of their texts. doc_id must be a whole number. Shingles compare by 40 bits and more of their
    hash, which grow with the number of parts; sizes and sets by 64 and 128. An empty table gives an
    empty result.
    """
    docs = keyed(docs, key, text).withColumnsRenamed({key: "doc_id", text: "text"}).withColumn("doc_id", F.col("doc_id").cast("long"))
    told = stored(document_sets(docs, width, "doc_id", "text"))
    sets = told.where("n_shingles >= 0")
    some = sets.where("n_shingles > 0 and doc_id is not null")
    reps = stored(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")))
    total, rows = some.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    parts = max(8, -(-total // REDUCER))
    hot = {(r.k1, r.k2): r.rep for r in reps.where(F.col("copies") > max(8, rows // HOT)).collect()}
    dealt = _dealt(docs, width, percent, int(parts), hot, common_shingles(told, rows), "doc_id", "text").repartition(int(parts), "part")
    found = stored(_candidates(_shared(dealt), percent))
    return _joined(docs, sets, reps, found, percent)


def _joined(docs: DataFrame, sets: DataFrame, reps: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    found = stored(found.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "tokens"]))
    sigs = found.select("doc_id", F.explode("sigs").alias("sig"))
    hubs = sigs.groupBy("sig").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").select("sig", "hub")
    star = sigs.join(hubs, "sig").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    classes = components(star)
    grouped = stored(found.drop("sigs").join(classes, F.col("doc_id") == F.col("node")).select(F.col("component").alias("comp"), "doc_id", "n", "tokens"))
    weight = grouped.groupBy("comp").agg(F.count("*").alias("c"), (F.sum(F.length("tokens")) / 8).alias("w"))
    big = _told(stored(weight.where((F.col("c") > CLASS_DOCS) | (F.col("w") > CLASS_SHINGLES)).select("comp")))
    links = grouped.join(big, "comp", "left_anti").groupBy("comp").applyInArrow(_classes(percent), "a bigint, b bigint")
    more = _rounds(grouped.join(big, "comp", "left_semi"), percent)
    links = links if more is None else links.unionByName(more)
    # ids that occur with several texts tie the classes of those texts together
    twice = sets.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x <> y").select("doc_id")
    ties = sets.join(twice, "doc_id", "left_semi").join(reps, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(stored(links.unionByName(ties)))
    own = sets.alias("s").join(reps.select("k1", "k2", "rep").alias("r"), ["k1", "k2"], "left")
    own = own.select("s.doc_id", "s.n_shingles", "r.rep").join(labels, F.col("rep") == F.col("node"), "left")
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "rep", "doc_id"), F.coalesce("rep", "doc_id"))).alias("component_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 90 percent, over the whole of documents: doc_id, n_shingles, component_id."""
    return similar_classes(table(spark, sf_dir, "documents"), 3, 90)
