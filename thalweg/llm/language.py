"""Document log-likelihood by a gated recurrent language model with a class-factored output.

Words are told apart by a 64-bit hash, which numpy takes of whole blocks of text. Spark counts all
words of all training documents. The commonest form the network's vocabulary; a rarer word costs the
network's probability of "other", times the word's smoothed share of the other words. A first fit on a
bounded sample starts the network; then every task trains a copy on all of its own documents, and the
copies are averaged by the tokens that they saw. Scoring carries the state through a whole document,
window after window.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashTable, batch, id_text_crc, keyed, many_word_hashes, map_arrow, stored, table, utf8

#: The hash that stands for the end of a document.
END = 0
#: Words of the network, other words that every task knows the counts of, hidden units, words in a class.
VOCABULARY, KNOWN, HIDDEN, CLASS = 2047, 200_000, 24, 64
#: Steps of a window, and documents side by side.
WINDOW, LANES = 16, 192
#: Training documents of the first fit, at most; passes over them.
SAMPLE, PASSES = 400, 2
#: Bytes of text that are laid into lanes at once; four times as many of texts longer than a lane's share.
CHUNK = 4 << 20
#: Words that a task gathers before it counts them; pieces of the weights that are averaged apart.
FLUSH, SLICES = 4_000_000, 128


def trains(doc_id: int | None) -> bool:
    return id_text_crc(doc_id) % 5 != 1


def training_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary"))
    return keyed(docs, key, text).toDF("k", "t").where(F.pmod(crc, F.lit(5)) != 1)


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, c): the hash and number of every word of the training documents' whole texts; END for their ends."""

    def run(batches, schema):
        held, n, ends = [], 0, 0

        def flush():
            words, c = np.unique(np.concatenate(held), return_counts=True)
            return batch(schema, words.view(np.int64), c)

        for b in batches:
            raw = utf8(b.column(0))
            ends += len(raw)
            held.append(many_word_hashes(raw)[0])
            n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
        if ends:
            yield batch(schema, [END], [ends])

    return map_arrow(training_rows(docs, key, text).select("t"), run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The commonest words with their counts: the network's first, the end of a document before all."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        own = words != END
        order = np.lexsort((words[own], -counts[own]))
        self.words = np.concatenate((np.zeros(1, np.uint64), words[own][order].view(np.uint64)))
        self.counts = np.concatenate(([counts[~own].sum()], counts[own][order])).astype(np.float64)
        self.total, self.distinct, self.n = total, distinct, min(VOCABULARY, len(self.words))
        own = self.counts[: self.n]
        self.other_total, self.other_distinct = total - own.sum(), distinct - int((own > 0).sum())
        self.logs = np.log10(self.counts + 0.5)
        self.base = np.log10(total + 0.5 * (distinct + 1))
        self.other = np.log10(max(0.0, self.other_total) + 0.5 * (max(0, self.other_distinct) + 1))

    def encoder(self, most: int | None = None):
        """texts -> ids of all their words and ends, words that aren't among the first `most` as `most`; lengths."""
        words = self.words[:most]
        places = HashTable(words[1:])

        def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, n = many_word_hashes(texts)
            ends = np.cumsum(n)
            return np.insert(places.find(h) + 1, ends, 0), n + 1, np.insert(h, ends, END)

        return encode


def lexicon(counts: DataFrame) -> Lexicon:
    """At most KNOWN words reach the driver: those above a count found from a histogram of logarithms."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bins = counts.groupBy(F.floor(F.log2("c") * 16).alias("b")).count().orderBy(F.desc("b")).collect()
    held, least = 0, None
    for r in bins:
        if held + r[1] > KNOWN:
            break
        held, least = held + r[1], r[0]
    rows = counts.where((F.floor(F.log2("c") * 16) >= (1 << 30 if least is None else least)) | (F.col("word") == END)).select("word", "c").toArrow()
    return Lexicon(rows["word"].to_numpy(), rows["c"].to_numpy(), int(total), int(distinct))


class GRU:
    """Words 0 to n - 1 and n for other words. Word w is place w % CLASS of class w // CLASS.

    States have a last column of ones, so that the last rows of C (classes) and O (places) are their biases.
    """

    def __init__(self, n: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.n, self.classes = n, -(-(n + 1) // CLASS)
        h, make = HIDDEN, lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        self.p = {"X": make(n + 1, 3 * h), "U": make(h, 3 * h), "C": 0.1 * make(h + 1, self.classes), "O": 0.1 * make(self.classes, h + 1, CLASS)}
        self.p["C"][-1], self.p["O"][:, -1] = 0, 0
        self.room: dict = {}
        self.blank()

    def begin(self, counts: np.ndarray) -> None:
        """Starts the output from counts of words 0 to n: without any state, their smoothed shares."""
        c = np.zeros(self.classes * CLASS)
        c[: self.n + 1] = np.maximum(counts, 0) + 0.5
        c = c.reshape(self.classes, CLASS)
        self.p["C"][-1] = np.log(c.sum(1) / c.sum())
        self.p["O"][:, -1] = np.log(np.maximum(c, 1e-30) / c.sum(1, keepdims=True))
        self.blank()

    def blank(self) -> None:
        """Places of the last class that no word has."""
        self.p["O"][-1, -1, (self.n + 1) - (self.classes - 1) * CLASS :] = -1e9

    def copy(self) -> "GRU":
        out = object.__new__(GRU)
        out.n, out.classes, out.p, out.room = self.n, self.classes, {k: v.copy() for k, v in self.p.items()}, {}
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"room": {}}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        self.blank()

    def space(self, name: str, *shape: int) -> np.ndarray:
        """Memory that is kept from one window to the next."""
        size = int(np.prod(shape))
        if name not in self.room or self.room[name].size < size:
            self.room[name] = np.empty(size, np.float32)
        return self.room[name][:size].reshape(shape)

    def steps(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step of x (steps by lanes); fresh: the lane begins a document there.

        Also the last state and, with keep, what a step saw and made: states before it, update and reset
        gates, candidate states and their recurrent part. All but the last state stay until the next call.
        """
        n, (T, lanes) = HIDDEN, x.shape
        X, U, flat = self.p["X"], self.p["U"], x.ravel()
        zr = np.take(X[:, : 2 * n], flat, axis=0, out=self.space("zr", T * lanes, 2 * n), mode="clip").reshape(T, lanes, 2 * n)
        c = np.take(X[:, 2 * n :], flat, axis=0, out=self.space("c", T * lanes, n), mode="clip").reshape(T, lanes, n)
        U1, U2 = np.ascontiguousarray(U[:, : 2 * n]), np.ascontiguousarray(U[:, 2 * n :])
        out, uc = self.space("out", T, lanes, n + 1), self.space("uc", T, lanes, n)
        before = self.space("before", T, lanes, n)
        out[..., n] = 1
        u, d, new = np.empty((lanes, 2 * n), np.float32), np.empty((lanes, n), np.float32), fresh.any(1)
        for t in range(T):
            at = before[t]
            at[:] = h
            if new[t]:
                at[fresh[t]] = 0
            g, m, k = zr[t], c[t], uc[t]
            np.dot(at, U1, out=u)
            np.add(g, u, out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)
            np.add(g, 1, out=g)
            np.reciprocal(g, out=g)
            np.dot(at, U2, out=k)
            np.multiply(k, g[:, n:], out=d)
            np.add(m, d, out=m)
            np.tanh(m, out=m)
            np.subtract(at, m, out=d)
            np.multiply(d, g[:, :n], out=d)
            h = np.add(m, d, out=out[t, :, :n])
        return out, h.copy(), (before, zr, c, uc)

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, grads: int = 0):
        """Natural logs of P(y | h) for rows; with grads also the gradients of the loss over so many."""
        C, O, rows = self.p["C"], self.p["O"], np.arange(len(y))  # noqa: E741
        # rows in the order of their classes: each class is one product, all else is done at once
        order = np.argsort((y // CLASS).astype(np.uint16), kind="stable")
        h, y = h[order], y[order]
        cls, place = y // CLASS, y % CLASS
        cut = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        spans = [(k, cut[k], cut[k + 1]) for k in range(self.classes) if cut[k] < cut[k + 1]]
        e = np.dot(h, C, out=self.space("classes", len(y), self.classes))
        l = self.space("places", len(y), CLASS)  # noqa: E741
        for k, a, b in spans:
            np.dot(h[a:b], O[k], out=l[a:b])
        own = np.zeros(len(y), np.float32)
        for x, target in ((e, cls), (l, place)):
            np.clip(x, -80, 80, out=x)
            own += x[rows, target]
            np.exp(x, out=x)
            s = x @ np.ones((x.shape[1], 1), np.float32)
            own -= np.log(s[:, 0])
            if grads:
                np.divide(x, s * np.float32(grads), out=x)
                x[rows, target] -= np.float32(1 / grads)
        out = np.empty(len(y), np.float32)
        out[order] = own
        if not grads:
            return out
        g = {"C": h.T @ e, "O": np.zeros_like(O)}
        dh = e @ C[:-1].T
        for k, a, b in spans:
            np.dot(h[a:b].T, l[a:b], out=g["O"][k])
            dh[a:b] += l[a:b] @ O[k, :-1].T
        back = np.empty_like(dh)
        back[order] = dh
        return out, g, back

    def learn(self, x, y, fresh, h, state: dict, rate: float, full: int) -> np.ndarray:
        """One window of truncated backpropagation; y is -1 where a lane has no word. Returns the last state.

        Every word weighs the same, one in `full`, however few lanes are left.
        """
        hs, last, (h0, zr, c, uc) = self.steps(x, fresh, h, True)
        ok, (T, lanes), U, n = y >= 0, x.shape, self.p["U"], HIDDEN
        if ok.all():
            _, g, dhs = self.log_probabilities(hs.reshape(-1, n + 1), y.ravel(), full)
            dhs = dhs.reshape(T, lanes, n)
        else:
            _, g, some = self.log_probabilities(hs[ok], y[ok], full)
            dhs = np.zeros((T, lanes, n), np.float32)
            dhs[ok] = some
        z, r = zr[..., :n], zr[..., n:]
        # what a state's gradient is multiplied by, for the gates and the candidate
        slope = self.space("slope", T, lanes, 2 * n)
        a = np.multiply(c, c, out=self.space("a", T, lanes, n))
        np.subtract(1, a, out=a)
        one = np.subtract(1, z, out=self.space("one", T, lanes, n))
        np.multiply(a, one, out=a)
        np.multiply(z, one, out=one)
        np.multiply(np.subtract(h0, c, out=slope[..., :n]), one, out=slope[..., :n])
        np.multiply(np.subtract(1, r, out=one), r, out=one)
        np.multiply(one, uc, out=one)
        np.multiply(one, a, out=slope[..., n:])
        UT, dU2 = np.ascontiguousarray(U.T), np.empty((lanes, n), np.float32)
        both, dh, new = self.space("both", T, lanes, 3 * n), np.zeros((lanes, n), np.float32), fresh.any(1)
        for t in range(T - 1, -1, -1):
            dh += dhs[t]
            d = both[t]
            np.multiply(slope[t].reshape(lanes, 2, n), dh[:, None], out=d[:, : 2 * n].reshape(lanes, 2, n))
            np.multiply(dh, a[t], out=d[:, 2 * n :])
            np.multiply(d[:, 2 * n :], r[t], out=dU2)
            dh *= z[t]
            dh += d[:, : 2 * n] @ UT[: 2 * n]
            dh += dU2 @ UT[2 * n :]
            if new[t]:
                dh[fresh[t]] = 0
        rows, before = both.reshape(-1, 3 * n), h0.reshape(-1, n).T
        g["U"] = np.hstack((before @ rows[:, : 2 * n], before @ (rows[:, 2 * n :] * r.reshape(-1, n))))
        # gradients of one word lie side by side and are added up; steps without a word have none
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        sums = np.add.reduceat(np.ascontiguousarray(rows.T).take(order, axis=1), first, axis=1).T
        ids = flat[first]
        for k, v in g.items():
            s = state.setdefault(k, np.full_like(self.p[k], 1e-5))
            s += v * v
            self.p[k] -= rate * v / np.sqrt(s)
        s = state.setdefault("X", np.full_like(self.p["X"], 1e-5))
        s[ids] += sums * sums
        self.p["X"][ids] -= rate * sums / np.sqrt(s[ids])
        self.blank()
        return last


class Lanes:
    """Documents laid into lanes of like length, one after the other; memory follows their tokens."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, lanes: int):
        heap = [(0, k) for k in range(min(lanes, len(lengths)))]
        rows: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-lengths, kind="stable"):
            used, k = heap[0]
            rows[k].append(int(i))
            heapq.heapreplace(heap, (used + int(lengths[i]), k))
        rows.sort(key=lambda r: -int(lengths[r].sum()))
        order = np.concatenate([np.array(r, np.int64) for r in rows])
        starts = np.cumsum(lengths) - lengths
        self.owner = np.repeat(order, lengths[order])
        ends = np.cumsum(lengths[order])
        self.tokens = tokens[np.arange(len(tokens)) + np.repeat(starts[order] - ends + lengths[order], lengths[order])]
        self.first = np.zeros(len(tokens), bool)
        self.first[ends - lengths[order]] = True
        self.length = np.array([int(lengths[r].sum()) for r in rows])
        self.start = np.cumsum(self.length) - self.length

    def windows(self):
        """(owners, inputs, outputs, fresh) of each window, steps by lanes that still run; -1 where a lane has ended.

        A document's first input is the end.
        """
        last = len(self.tokens) - 1
        for t in range(0, int(self.length[0]), WINDOW):
            lanes = int((self.length > t).sum())
            step = t + np.arange(min(WINDOW, int(self.length[0]) - t))[:, None]
            ok = step < self.length[:lanes]
            at = np.minimum(self.start[:lanes] + step, last)
            fresh = self.first[at] & ok
            yield self.owner[at], np.where(fresh | ~ok, 0, self.tokens[at - 1]), np.where(ok, self.tokens[at], -1), fresh


def learn_documents(net: GRU, tokens: np.ndarray, lengths: np.ndarray, state: dict, rate: float) -> int:
    """Trains on every window, carrying states through; returns the tokens."""
    laid = Lanes(tokens, lengths, LANES)
    h = np.zeros((len(laid.length), HIDDEN), np.float32)
    for _, x, out, new in laid.windows():
        h = net.learn(x, out, new, h[: x.shape[1]], state, rate, WINDOW * len(laid.length))
    return len(tokens)


def score_documents(net: GRU, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-probability of each whole document."""
    laid = Lanes(tokens, lengths, LANES)
    total, h = np.zeros(len(lengths)), np.zeros((len(laid.length), HIDDEN), np.float32)
    for owner, x, out, new in laid.windows():
        hs, h, _ = net.steps(x, new, h[: x.shape[1]])
        ok = out >= 0
        total += np.bincount(owner[ok], weights=net.log_probabilities(hs[ok], out[ok]), minlength=len(lengths))
    return total


def _chunks(batches):
    """Lists of keys and texts, about CHUNK bytes at a time; long texts wait for each other, so that lanes stay even."""
    held: tuple[list, list] = ([], [])
    size = [0, 0]
    for b in batches:
        for key, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            k = int(len(t) > CHUNK // LANES)
            held[k].append((key, t))
            size[k] += len(t) + 1
            if size[k] >= CHUNK * (1, 4)[k]:
                yield map(list, zip(*held[k]))
                held[k].clear()
                size[k] = 0
    if held[0] or held[1]:
        yield map(list, zip(*held[0], *held[1]))


def train(docs: DataFrame, lex: Lexicon, key: str, text: str) -> GRU:
    """A first fit on the driver, then one pass of every task over all its training documents, averaged.

    The first fit reads at most SAMPLE documents, those of the least hash of key and text.
    """
    mine = training_rows(docs, key, text)
    n, h = mine.count(), F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("")), F.coalesce("t", F.lit("")))
    # a hash picks twice as many as are wanted first, so that few whole texts are sorted
    sample = mine.where(F.pmod(h, F.lit(max(n, 1))) < 2 * SAMPLE).orderBy(h, "k", "t").limit(SAMPLE).collect()
    net, state, most = GRU(lex.n), {}, lex.n
    net.begin(np.append(lex.counts[:most], lex.other_total))
    if sample:
        tokens, lengths, _ = lex.encoder(most)([(r.t or "").encode() for r in sample])
        for _ in range(PASSES):
            learn_documents(net, tokens, lengths, state, 0.05)
    words = Lexicon.encoder  # the closure below takes the network's words alone
    small = object.__new__(Lexicon)
    small.words = lex.words[:most]

    def run(batches, schema):
        own, seen, state_, encode = net.copy(), 0, {k: v.copy() for k, v in state.items()}, words(small)
        for _, texts in _chunks(batches):
            tokens, lengths, _ = encode(texts)
            seen += learn_documents(own, tokens, lengths, state_, 0.05)
        if seen:
            parts = np.array_split((own.flat() * np.float32(seen)).astype("<f4"), SLICES)
            yield batch(schema, range(SLICES), [p.tobytes() for p in parts], [seen] * SLICES)

    def add(batches, schema):
        total: dict = {}
        for b in batches:
            for k, w, m in zip(*(c.to_pylist() for c in b.columns)):
                was = total.get(k, (0.0, 0))
                total[k] = was[0] + np.frombuffer(w, "<f4").astype(np.float64), was[1] + m
        if total:
            yield batch(schema, list(total), [v.tobytes() for v, _ in total.values()], [m for _, m in total.values()])

    ddl = "slice int, weights binary, seen bigint"
    parts = map_arrow(map_arrow(mine, run, ddl).repartition("slice"), add, ddl).orderBy("slice").collect()
    if parts:
        net.load(np.concatenate([np.frombuffer(r.weights) / r.seen for r in parts]))
    return net


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Learns from rows whose crc32(key as text) mod 5 is not 1. Null text counts as empty (the end alone);
    a null key counts as the empty text in that remainder. Repeated rows are documents of their own. With
    no training rows, counts are 0 and the network is untrained. An empty table gives an empty result.
    Counts of the KNOWN commonest words are told to every task; those of the others are joined.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    counts = stored(word_counts(docs, key, text))
    lex = lexicon(counts)
    net = train(docs, lex, key, text)
    shared = spark.sparkContext.broadcast(lex)

    def run(batches, schema):
        lex = shared.value
        encode, none, n = lex.encoder(), len(lex.words), lex.n
        logs, had = np.append(lex.logs, 0.0), np.append(lex.counts > 0, False)
        for keys, texts in _chunks(batches):
            ids, lengths, h = encode(texts)
            starts = np.cumsum(lengths) - lengths
            sums = lambda x: np.add.reduceat(x, starts)
            far, own = ids >= n, logs[ids]
            net_logs = score_documents(net, np.minimum(ids, n), lengths) / np.log(10)
            cold = np.flatnonzero(ids == none)
            owner = np.searchsorted(starts, cold, "right") - 1
            order = np.lexsort((h[cold], owner))
            owner, words = owner[order], h[cold][order].view(np.int64)
            begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(words)), bool), (owner[1:] != owner[:-1]) | (words[1:] != words[:-1]))))
            often = np.diff(np.append(begin, len(words)))
            cut = pa.array(np.searchsorted(owner[begin], np.arange(len(keys) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(v.astype(np.int64))) for v in (words[begin], often)]
            columns = [lengths, sums(had[ids].astype(np.int64)), sums(own), sums(np.where(far, own, 0.0)), sums(far.astype(np.int64)), net_logs]
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), *(pa.array(c) for c in columns), *(x.cast(f.type) for x, f in zip(lists, list(schema)[-2:]))], schema=schema)

    ddl = f"doc_id {kind}, n_tokens bigint, held bigint, logs double, far_logs double, far bigint, net double, rare array<bigint>, often array<bigint>"
    near = stored(map_arrow(keyed(docs, key, text), run, ddl).withColumn("row", F.monotonically_increasing_id()))
    cold = near.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.often").alias("n"))
    cold = cold.join(counts, "word", "left").groupBy("row")
    cold = cold.agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("also"))
    both = near.drop("rare", "often").join(cold, "row", "left")
    crc, more = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.coalesce("more", F.lit(0.0))
    return both.select(
        "doc_id", (F.pmod(crc, F.lit(5)) == 1).alias("held_out"), "n_tokens",
        (F.col("held") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(lex.base))).alias("base_score"),
        (F.col("net") + F.col("far_logs") + more - F.col("far") * F.lit(float(lex.other))).alias("score"),
    )


def op5_language_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the whole of documents."""
    return score(table(spark, sf_dir, "documents"))
