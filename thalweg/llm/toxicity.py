"""Toxicity: subword-bag embeddings averaged over windows of words into a linear softmax.

A word's vector is the mean of the vectors of its byte n-grams, a window's the mean of its words'.
Both the n-gram table and the softmax are trained together. As the output is linear, a word adds a
fixed amount to its window, so scoring looks words up and slides a mean; a text's score comes from
its highest window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, hash64, keyed, map_arrow, table, utf8

BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5)
#: Words in a window.
WINDOW = 6
#: Labelled rows that training reads at most: toxic ones and others.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
THRESHOLD = 0.3
#: Words whose amounts a worker remembers.
CACHE = 400_000
EDGES = b".,;:!?\"'()[]{}*#%&$|-_~`<>/\\+=^@"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, and which word each belongs to. Words are stripped of edge signs."""
    marked = [b"\x01" + (w.strip(EDGES) or w) + b"\x02" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(b))
    ids, own = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(b), np.uint64)
        for k in range(max(GRAMS)):
            nxt = np.zeros(len(b), np.uint64)
            nxt[: len(b) - k] = b[k:]
            h = h * np.uint64(0x100000001B3) + nxt + np.uint64(1)
            if k + 1 in GRAMS:
                ok = at + k < end
                ids.append(hash64(h[ok] + np.uint64(k)) % np.uint64(BUCKETS))
                own.append(owner[ok])
    return np.concatenate(ids).astype(np.int64), np.concatenate(own)


class SubwordModel:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.E = r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.W = r.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.scale, self.shift, self.prior, self.empty = 1.0, 0.0, None, 0.0

    def amounts(self, words: list[bytes]) -> np.ndarray:
        """What each word adds: its vector times the difference of the two outputs."""
        if not words:
            return np.zeros(0, np.float32)
        ids, own = grams(words)
        per = (self.E @ (self.W[:, 1] - self.W[:, 0]))[ids]
        n = np.bincount(own, minlength=len(words))
        return (np.bincount(own, weights=per, minlength=len(words)) / np.maximum(n, 1)).astype(np.float32)

    @staticmethod
    def means(amounts: np.ndarray) -> np.ndarray:
        """Means over every window of WINDOW words (all words, if fewer)."""
        n = min(WINDOW, len(amounts))
        total = np.concatenate(([0.0], np.cumsum(amounts, dtype=np.float64)))
        return (total[n:] - total[:-n]) / n

    def logit(self, amounts: np.ndarray) -> float:
        return float(self.means(amounts).max() + self.b[1] - self.b[0]) if len(amounts) else self.empty

    def probability(self, logits: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(logits), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.scale * np.asarray(logits) + self.shift, -40, 40)))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 8, seed: int = 5) -> "SubwordModel":
        """Four fifths train, one fifth calibrates. A text's label holds for the window that now scores highest.

        In the first epoch, random windows stand in. Without both labels the score is the label's share.
        """
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            self.prior = float(y.mean()) if len(y) else 0.0
            return self
        r = np.random.default_rng(seed)
        vocabulary: dict[bytes, int] = {}
        rows = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()), np.int64) for t in texts]
        parts, counts, every = [], [], list(vocabulary)
        for k in range(0, len(every), 20_000):  # a few words at once: the arrays of all would fill the driver
            some_ids, own = grams(every[k : k + 20_000])
            parts.append(some_ids[np.argsort(own, kind="stable")].astype(np.int32))
            counts.append(np.bincount(own, minlength=len(every[k : k + 20_000])))
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        first = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))))
        share = len(vocabulary)
        order = np.array([i for i in r.permutation(len(rows)) if len(rows[i])])
        if not len(order):
            self.prior = float(y.mean())
            return self
        hold, own_rows = order[: len(order) // 5], order[len(order) // 5 :]
        weight = np.array([0.5 / max(1e-9, 1 - y.mean()), 0.5 / max(1e-9, y.mean())], np.float32)
        g2e, g2w = np.full((BUCKETS, 1), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
        inverse = np.empty(0)

        def all_amounts() -> np.ndarray:
            per = (self.E @ (self.W[:, 1] - self.W[:, 0]))[ids]
            return np.add.reduceat(per, first[:-1]) / np.diff(first)  # every word has a gram

        for epoch in range(epochs):
            amount = all_amounts() if epoch else np.zeros(share)
            picks: list[tuple[np.ndarray, int]] = []
            for i in own_rows:
                w = rows[i]
                n = min(WINDOW, len(w))
                if epoch:
                    a = int(self.means(amount[w]).argmax())
                    picks.append((w[a : a + n], y[i]))
                else:
                    for _ in range(min(40, 1 + len(w) // WINDOW)):
                        a = int(r.integers(len(w) - n + 1))
                        picks.append((w[a : a + n], y[i]))
            if epoch:  # windows of clean texts anywhere, so that common words stay neutral
                for i in own_rows:
                    if not y[i]:
                        a = int(r.integers(len(rows[i]) - min(WINDOW, len(rows[i])) + 1))
                        picks.append((rows[i][a : a + WINDOW], 0))
            for k in r.permutation(-(-len(picks) // 64)):
                some = picks[k * 64 : k * 64 + 64] if epoch else picks[k :: -(-len(picks) // 64)]
                lens = np.array([len(w) for w, _ in some])
                ws = np.concatenate([w for w, _ in some])
                doc = np.repeat(np.arange(len(some)), lens)
                n = np.diff(first)[ws]
                at = np.repeat(first[ws] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                gram = ids[at]
                per = (1 / np.maximum(n, 1) / lens[doc]).astype(np.float32)
                gd, gw = np.repeat(doc, n), np.repeat(per, n)
                vectors = self.E[gram] * gw[:, None]
                starts = np.concatenate(([0], np.cumsum(np.bincount(gd, minlength=len(some)))[:-1]))
                bag = np.add.reduceat(vectors, starts, axis=0)
                z = bag @ self.W + self.b
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                t = np.array([v for _, v in some])
                p[np.arange(len(some)), t] -= 1
                p *= weight[t][:, None]
                gW, gB = bag.T @ p, p @ self.W.T
                u, inverse = np.unique(gram, return_inverse=True)
                full = gB[gd] * gw[:, None]
                ge = np.stack([np.bincount(inverse, weights=full[:, d], minlength=len(u)) for d in range(DIM)], 1)
                g2e[u] += (ge * ge).mean(1, keepdims=True).astype(np.float32)
                g2w += (gW * gW).astype(np.float32)
                self.E[u] -= (0.3 * ge / np.sqrt(g2e[u])).astype(np.float32)
                self.W -= (0.1 * gW / np.sqrt(g2w)).astype(np.float32)
                self.b -= (0.05 * p.mean(0)).astype(np.float32)
        amount = all_amounts()
        z = np.array([self.logit(amount[rows[i]]) for i in hold])
        a, b, t = 1.0 / max(1.0, float(z.std())), 0.0, y[hold]
        # a text without words is as likely toxic as the median document that isn't
        self.empty = float(np.median(z[t == 0])) if (t == 0).any() else 0.0
        for _ in range(2000):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            a, b = a - 0.02 * float(((p - t) * z).mean()), b - 0.05 * float((p - t).mean())
        self.scale, self.shift = max(a, 1e-3), b
        return self


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> SubwordModel:
    """Fits on at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows, of those whose crc32(key as text) mod 4 is not 2.

    A hash of the key picks the rows; of the texts of a repeated key, the least and the largest train. Rows
    whose key or label is null take no part.
    """
    known = keyed(labels, key, label).toDF("k", "y").where("k is not null and y in (0, 1)").where(F.pmod(F.crc32(F.col("k").cast("string").cast("binary")), F.lit(4)) != 2).distinct()
    some = None
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most)
        some = part if some is None else some.unionByName(part)
    texts = keyed(docs, key, text).toDF("k", "t").join(F.broadcast(some), "k")
    t = F.coalesce("t", F.lit(""))
    texts = texts.groupBy("k", "y").agg(F.array_distinct(F.array(F.min(t), F.max(t))).alias("t")).select("k", "y", F.explode("t").alias("t"))
    rows = sorted(texts.collect(), key=lambda r: (r.k, r.y, r.t))
    return SubwordModel().fit([r.t.encode() for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: SubwordModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, score (0 to 1) of each whole text, and the columns named in keep.

    Null text counts as empty; an empty text gets the score of the median clean document. Each row is scored alone, so
    null keys, repeated rows and other columns change nothing.
    """

    def run(batches, schema):
        cache: dict[bytes, float] = {}
        for b in batches:
            rows = [t.lower().split() for t in utf8(b.column(1))]
            unknown = list({w for ws in rows for w in ws}.difference(cache))
            if len(cache) + len(unknown) > CACHE:
                cache.clear()
                unknown = list({w for ws in rows for w in ws})
            for k in range(0, len(unknown), 20_000):
                part = unknown[k : k + 20_000]
                cache.update(zip(part, model.amounts(part).tolist()))
            z = [model.logit(np.fromiter((cache[w] for w in ws), np.float64, len(ws))) for ws in rows]
            yield batch(schema, b.column(0), model.probability(np.array(z)), *b.columns[2:])

    kinds = dict(docs.dtypes)
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return map_arrow(keyed(docs, key, text, *keep), run, f"`{key}` {kinds[key]}, score double{more}")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the whole of documents; rows whose crc32(doc_id as text) mod 4 is 2 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return scored.select("doc_id", (F.pmod(crc, F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

