"""Secret scan: rule spans, and spans that a character convolutional network accepts.

Every candidate (a run of key-like characters) is scored by the network together with its
surrounding text. Rule spans are always kept; other candidates are kept from a threshold on.
The network learns from the findings of every document: four fifths train it, the others set its threshold.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, keyed, map_arrow, stored, table

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of [0-9a-f]+ are leftmost and greedy, so those of 32 or more are what this finds.
HEX = re.compile(r"[0-9a-f]{32,}")
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MIXED = re.compile(r"[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]|[a-z][A-Z]")

#: Characters of text before and after a candidate that the network sees.
BEFORE, AFTER = 24, 8
#: Made findings of the first fit, and the least number made for a table; each document gets as many, one or more.
MADE = 1500
#: Rounds over all training findings, dealt over one bucket for EACH of them, BUCKETS at most.
ROUNDS, EACH, BUCKETS = 4, 4096, 512
#: Findings, and bytes of codes, that a task holds at once; equal findings that are numbered at once.
BLOCK, BLOCK_BYTES, EQUAL = 4096, 4 << 20, 1 << 16
#: Places that a convolution takes at once.
PIECE = 4096
#: Logits count in steps of 1 / STEP between -LIMIT and LIMIT.
STEP, LIMIT = 256, 32
#: The share of labelled calibration secrets that the threshold must keep.
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' spans, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Key-like runs of mixed characters outside the rules' spans; a run that meets some is cut at them."""
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for s, e in [*((s, e) for s, _, e in base if s < m.end() and at < e), (m.end(), m.end())]:
            if s - at >= SHORTEST and MIXED.search(text, at, s):
                out.append((at, s))
            at = max(at, e)
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a candidate and its context: 1 to 127, plus 128 within the candidate."""
    a = max(0, start - BEFORE)
    raw = np.frombuffer(text[a : end + AFTER].encode("utf-32-le", "replace"), "<u4")
    codes = np.where(raw < 127, raw + 1, 127).astype(np.int64)
    codes[start - a : end - a] += 128
    return codes


class CharNet:
    """Embedding, one convolution, ReLU, maximum over all places, logistic output; Adam in numpy."""

    DIM, WIDTH, FILTERS = 8, 5, 32

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.3, (256, self.DIM)), "C": r.normal(0, 0.2, (self.WIDTH * self.DIM, self.FILTERS)), "c": np.zeros(self.FILTERS), "w": r.normal(0, 0.2, self.FILTERS), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["E"][0] = 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.learned = self.held = 0  # findings of a table that trained, and that set the threshold

    def tops(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over all places, and its place, in pieces of PIECE places, so that memory doesn't follow the length."""
        top, at = np.zeros((len(x), self.FILTERS), np.float32), np.zeros((len(x), self.FILTERS), np.int64)
        for k in range(0, x.shape[1] - self.WIDTH + 1, PIECE):
            e = self.p["E"][x[:, k : k + PIECE + self.WIDTH - 1]]
            places = e.shape[1] - self.WIDTH + 1
            h = np.concatenate([e[:, j : j + places] for j in range(self.WIDTH)], axis=2) @ self.p["C"] + self.p["c"]
            best = h.argmax(1)
            value = np.take_along_axis(h, best[:, None, :], 1)[:, 0]
            more = value > top
            top[more], at[more] = value[more], best[more] + k
        return top, at

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        top, at = self.tops(x)
        z = top @ self.p["w"] + self.p["b"][0]
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        g = {"w": top.T @ d, "b": np.array([d.sum()], np.float32)}
        dh = d[:, None] * self.p["w"] * (top > 0)
        seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(self.WIDTH)]
        g["C"] = np.einsum("nfc,nf->cf", self.p["E"][seen].reshape(*at.shape, -1), dh)
        g["c"] = dh.sum(0)
        back = (dh[:, :, None] * self.p["C"].T[None]).reshape(-1, self.DIM)
        g["E"] = np.stack([np.bincount(seen.ravel(), back[:, j], 256) for j in range(self.DIM)], 1).astype(np.float32)
        g["E"][0] = 0
        state["t"] = t = state.get("t", 0) + 1
        for k, v in g.items():
            m, s = state.get(k, (0, 0))
            m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
            state[k] = m, s
            self.p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    @staticmethod
    def batches(codes: list[np.ndarray], most: int, order=None):
        """(indexes, padded codes) of like length, at most `most` candidates or about 32768 places at once."""
        by: dict[int, list[int]] = {}
        for i in range(len(codes)) if order is None else order:
            by.setdefault(max(64, 1 << (len(codes[i]) - 1).bit_length()), []).append(int(i))
        for length, own in by.items():
            some = max(1, min(most, 32768 // length))
            for k in range(0, len(own), some):
                part = own[k : k + some]
                x = np.zeros((len(part), length), np.int16)
                for j, i in enumerate(part):
                    x[j, : len(codes[i])] = codes[i]
                yield part, x

    def logits(self, codes: list[np.ndarray]) -> np.ndarray:
        """Candidates of any length, in batches of like length, so that padding stays small."""
        out = np.zeros(len(codes))
        for part, x in self.batches(codes, 1 << 15):
            out[part] = self.tops(x)[0] @ self.p["w"] + self.p["b"][0]
        return out

    def steps(self, codes: list[np.ndarray]) -> np.ndarray:
        """Logits in whole steps, so that the same counts tell the same threshold."""
        return np.clip(np.rint(self.logits(codes) * STEP), -LIMIT * STEP, LIMIT * STEP).astype(np.int64)

    def probability(self, steps: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(steps / STEP * self.scale + self.shift, -30, 30)))

    def scores(self, codes: list[np.ndarray]) -> np.ndarray:
        return self.probability(self.steps(codes))

    def learn(self, codes: list[np.ndarray], labels: np.ndarray, order: np.ndarray, state: dict, rate: float, r: np.random.Generator) -> None:
        """One pass over the findings that order names, in batches of like length."""
        todo = list(self.batches(codes, 64, order))
        for k in r.permutation(len(todo)):
            part, x = todo[k]
            self.step(x, labels[part], state, rate)

    def calibrate(self, steps: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Scale, shift and threshold from n findings of label y at each logit, in steps."""
        z, share, a, b = steps / STEP, n / n.sum(), 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.1 * ((p - y) * z * share).sum(), b - 0.1 * ((p - y) * share).sum()
        self.scale, self.shift, self.threshold = float(max(a, 1e-3)), float(b), 0.5
        own = np.flatnonzero((y == 1) & (n > 0))
        if len(own):
            own = own[np.argsort(-steps[own], kind="stable")]
            kept = np.cumsum(n[own])
            self.threshold = float(min(0.5, self.probability(steps[own[np.searchsorted(kept, RECALL * kept[-1])]])))

    def fit(self, codes: list[np.ndarray], labels: np.ndarray, epochs: int = 6, seed: int = 2) -> "CharNet":
        """Trains on four fifths; calibrates and sets the threshold on the other fifth."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(codes))
        hold, train = order[: len(order) // 5], order[len(order) // 5 :]
        state: dict = {}
        for epoch in range(epochs):
            r.shuffle(train)
            self.learn(codes, labels, train, state, 0.01 * 0.7**epoch, r)
        self.calibrate(self.steps([codes[i] for i in hold]), labels[hold], np.ones(len(hold)))
        return self

    def copy(self) -> "CharNet":
        out = CharNet()
        out.load(self.flat())
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def made_finding(r: np.random.Generator, label: int, contexts: list[str]) -> np.ndarray:
    """A finding of a public credential format (label 1) or a harmless look-alike (0), set into a context."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, k: "".join(r.choice(list(chars), k))
    word = lambda: draw(low, int(r.integers(3, 9)))
    secrets = [
        lambda: "ghp_" + draw(low + up + num, 36), lambda: "sk_live_" + draw(low + up + num, 24), lambda: "xoxb-" + draw(num, 11) + "-" + draw(low + up + num, 24),
        lambda: "AIza" + draw(low + up + num + "_-", 35), lambda: "eyJ" + draw(low + up + num, 30) + "." + draw(low + up + num + "_-", 60), lambda: draw(low + up + num + "+/", 40),
        lambda: draw(up + num, int(r.integers(20, 33))), lambda: draw(num + "abcdef", int(r.integers(20, 32))), lambda: draw(low + up + num + "+/", 43) + "=",
    ]
    harmless = [
        lambda: "-".join(word() for _ in range(int(r.integers(4, 7)))), lambda: f"20{draw(num, 2)}-{draw('01', 2)}-{draw('012', 2)}T{draw('01', 2)}.{draw('012345', 2)}.00", lambda: "/".join(word() for _ in range(4)) + f"/{draw(num, 3)}.html",
        lambda: draw(num, 6) + "." + draw(num, 12), lambda: "=" * int(r.integers(16, 40)), lambda: "".join(w.capitalize() for w in (word(), word(), word(), word())), lambda: f"{word()}_{word()}_{word()}_{draw(num, 2)}",
        lambda: f"{word()}.{word()}{draw(num, 2)}.example.com", lambda: (word() + draw(num, 1)) * 4, lambda: f"{word()}{word()}{word()}{draw(num, 1)}",
    ]
    kinds = secrets if label else harmless
    s = kinds[int(r.integers(len(kinds)))]()
    around = contexts[int(r.integers(len(contexts)))] if contexts else ""
    cut = int(r.integers(len(around) + 1))
    before = around[:cut] + (" " if cut else "")
    return encode(before + s + " " + around[cut:], len(before), len(before) + len(s))


def made_findings(contexts: list[str], n: int, seed: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Made findings, of label 0 and 1 by turns, set into contexts."""
    r = np.random.default_rng(seed)
    return [made_finding(r, k % 2, contexts) for k in range(n)], np.arange(n, dtype=np.float32) % 2


def labelled_findings(text: str, seed: int, made: int):
    """(codes, label) of a text: the rules' spans (1), other key-like runs outside them that carry no sign of a
    key, which is to say fewer than four digits (0), and made findings set into its middle (0 and 1 by turns)."""
    base = base_spans(text)
    for s, _, e in base:
        yield encode(text, s, e), 1
    for s, e in other_candidates(text, base):
        c = encode(text, s, e)
        if ((c >= 128 + 49) & (c <= 128 + 58)).sum() < 4:
            yield c, 0
    r, around = np.random.default_rng(seed % (1 << 64)), text[len(text) // 2 : len(text) // 2 + 60]
    for k in range(seed % 2, seed % 2 + made):
        yield made_finding(r, k % 2, [around]), k % 2


def labelled(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every labelled finding of every document, and MADE made ones or one a document, whichever are more."""
    rows = keyed(docs, key, text).toDF("k", "t")
    made = -(-MADE // max(1, min(MADE, rows.count())))
    h = F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("")), F.coalesce("t", F.lit("")))

    def run(batches, schema):
        out, size = [], 0
        for b in batches:
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for place, (c, y) in enumerate(labelled_findings(t or "", h, made)):
                    out.append((h, place, c.astype(np.uint8).tobytes(), y))
                    size += len(c)
                    if len(out) == BLOCK or size >= BLOCK_BYTES:
                        yield batch(schema, *zip(*out))
                        out, size = [], 0
        if out:
            yield batch(schema, *zip(*out))

    return map_arrow(rows.select("t", h.alias("h")), run, "h bigint, place bigint, codes binary, label int")


def blocks(batches):
    """(bucket, codes, labels) of one bucket at a time, at most BLOCK findings or about BLOCK_BYTES codes at once."""
    bucket, codes, labels, size = None, [], [], 0
    for b in batches:
        for k, c, y in zip(*(x.to_pylist() for x in b.columns)):
            if codes and (k != bucket or len(codes) == BLOCK or size >= BLOCK_BYTES):
                yield bucket, codes, np.array(labels, np.float32)
                codes, labels, size = [], [], 0
            bucket = k
            codes.append(np.frombuffer(c, np.uint8))
            labels.append(y)
            size += len(c)
    if codes:
        yield bucket, codes, np.array(labels, np.float32)


def train(docs: DataFrame, text: str = "text", key: str = "doc_id") -> CharNet:
    """Fits the network on the labelled findings of all documents.

    A first fit on made findings alone is where every bucket begins. In each round every bucket trains a copy on all
    its findings, and the copies are averaged by their findings. A hash of text, key, place and number among equal
    ones deals findings over buckets, and one in five to those that don't train: scale, shift and threshold come from
    counts of all of these by logit and label. The driver holds BUCKETS copies of the network, or the counts, at
    most. Buckets are sorted, so that neither partitions nor reruns change the fit.
    """
    net = CharNet().fit(*made_findings([], MADE))
    found = stored(labelled(docs, text, key).groupBy("h", "place", "codes", "label").agg(F.count("*").alias("rows")))
    n = found.agg(F.sum("rows")).first()[0]
    if not n:
        return net
    # equal rows give equal findings; a number, in two steps so that no array is long, deals them out too
    found = found.withColumn("many", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / EQUAL))))
    found = found.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(EQUAL).cast("long"), F.col("rows") - F.col("many") * EQUAL))))
    own = ("h", "place", "many", "again")
    buckets = max(1, min(BUCKETS, n // EACH))
    held = F.pmod(F.xxhash64(*own), F.lit(5)) == 0
    dealt = found.withColumn("bucket", F.pmod(F.hash(*own), F.lit(buckets))).withColumn("held", held)

    def by_bucket(some: Column) -> DataFrame:
        rows = dealt.where(some).repartition(buckets, "bucket").sortWithinPartitions("bucket", *own, "codes")
        return rows.select("bucket", "codes", "label")

    def learn(turn: int):
        def run(batches, schema):
            for bucket, own in itertools.groupby(blocks(batches), lambda x: x[0]):
                copy, state, seen, r = net.copy(), {}, 0, np.random.default_rng([turn, bucket])
                for _, codes, labels in own:
                    copy.learn(codes, labels, r.permutation(len(codes)), state, 0.01 * 0.7**turn, r)
                    seen += len(codes)
                yield batch(schema, [bucket], [seen], [copy.flat().tobytes()])

        return run

    def tally(batches, schema):
        for _, codes, labels in blocks(batches):
            yield batch(schema, net.steps(codes), labels.astype(np.int32))

    for turn in range(ROUNDS):
        copies = map_arrow(by_bucket(~F.col("held")), learn(turn), "bucket int, seen bigint, weights binary").orderBy("bucket").collect()
        net.learned = sum(c.seen for c in copies)
        if copies:
            net.load(sum(c.seen / net.learned * np.frombuffer(c.weights, np.float32).astype(np.float64) for c in copies))
    counts = map_arrow(by_bucket(F.col("held")), tally, "z bigint, label int").groupBy("z", "label").count().orderBy("z", "label").collect()
    if counts:
        net.calibrate(*(np.array([r[k] for r in counts]) for k in range(3)))
    net.held = sum(r["count"] for r in counts)
    return net


def scan(docs: DataFrame, net: CharNet, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key and spans, an array of (kind, start, end, score) over the whole text.

    Starts and ends count code points, ends exclusive. Rule spans come whatever their score; runs
    outside them come as kind `model` from net.threshold on. Null text counts as empty: no spans. Null
    keys, repeated rows and other columns change nothing: each row is scanned alone. An empty table
    gives an empty result.
    """

    def run(batches, schema):
        for b in batches:
            keys, rows = b.column(0), []
            todo: list[np.ndarray] = []
            found = []
            for t in b.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                spans = [[s, k, e, None] for s, k, e in base] + [[s, 3, e, None] for s, e in other_candidates(t, base)]
                for sp in spans:
                    todo.append(encode(t, sp[0], sp[2]))
                found.append(spans)
            score = iter(net.scores(todo) if todo else ())
            for spans in found:
                kept = []
                for s, k, e, _ in spans:
                    v = float(next(score))
                    if k < 3 or v >= net.threshold:
                        kept.append((s, k, e, v))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "score": v} for s, k, e, v in sorted(kept)])
            yield batch(schema, keys, rows)

    kind = dict(docs.dtypes)[key]
    return map_arrow(keyed(docs, key, text), run, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of scan() over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_digest(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
    )
