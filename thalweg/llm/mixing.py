"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, keyed, map_arrow, ranked, stored, table, utf8

WEIGHTS, MOST, SEED = (1.0, 2.0, 3.0), 3, 17
#: Words of a budget that dynamic programming fits exactly; what is above is spent in proportion first.
EXACT = 1 << 17


def n_words(text: bytes) -> int:
    """Runs of [^\\x20\\x09-\\x0D]+."""
    b = np.frombuffer(text, np.uint8)
    word = (b != 32) & ((b < 9) | (b > 13))
    return int(word[:1].sum() + (word[1:] & ~word[:-1]).sum())


def targets(sizes: dict, weights: tuple = WEIGHTS, most: int = MOST) -> dict:
    """Shares of all sizes by weight, none above `most` times its source's size.

    Sources come by code point, null last, and take the weights in turn. What a source can't take is
    shared anew by weight among those below their limit, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents of each size to take, so that their sizes add up as near to budget as it finds.

    The same share of each size is taken first, then the largest that still fit, until `exact` words
    are left; bounded-knapsack dynamic programming over what remains fits those. A sum just above
    the budget wins if it is nearer.
    """
    take = np.zeros(len(sizes), np.int64)
    usable = sizes > 0
    total = int((sizes * counts)[usable].sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return np.where(usable, counts, 0)
    if budget > exact:
        take = np.where(usable, (counts.astype(object) * (budget - exact // 2) // total).astype(np.int64), 0)
    left = budget - int((sizes * take).sum())
    for k in np.argsort(-sizes):
        if left <= exact or not usable[k]:
            break
        n = min(int(counts[k] - take[k]), left // int(sizes[k]), -(-(left - exact // 2) // int(sizes[k])))
        take[k] += max(n, 0)
        left -= max(n, 0) * int(sizes[k])
    some = [k for k in np.argsort(-sizes) if usable[k] and counts[k] > take[k]]
    if left <= 0 or not some:
        return take
    top = left + int(min(sizes[k] for k in some))
    reached, by = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int64)
    reached[0], items = True, []
    for k in some:
        n, part = min(int(counts[k] - take[k]), top // int(sizes[k])), 1
        while n > 0:
            part = min(part, n)
            step = part * int(sizes[k])
            if step <= top:
                new = np.flatnonzero(reached[: top + 1 - step] & ~reached[step:]) + step
                by[new] = len(items)
                reached[new] = True
                items.append((k, part, step))
            n, part = n - part, part * 2
        if reached[left]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - left).argmin()])
    while at:
        k, part, step = items[by[at]]
        take[k] += part
        at -= step
    return take


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies: how often the mix takes each document.

    Every source is taken whole as often as its target holds it, and the rest of its budget is fitted
    by fit_budget over its exact sizes; a seeded hash says which documents of a size are taken. Reruns
    agree. Null text has size 0; documents of size 0 go in as often as the whole source does. A null
    source is a source of its own, after the others. Repeated rows are documents of their own; null keys
    are hashed as the empty text. An empty table gives an empty result.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)

    def run(batches, schema):
        for b in batches:
            yield batch(schema, b.column(0), b.column(2), [n_words(t) for t in utf8(b.column(1))], b.column(3))

    sized = stored(map_arrow(keyed(docs, key, text, source).withColumn("h", text_hash(text)), run, f"doc_id {kinds[key]}, source {kinds[source]}, size bigint, text_hash bigint"))
    totals = {r[0]: int(r[1] or 0) for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    goal = targets(totals, weights, most)
    whole = {s: int(min(most, goal[s] // totals[s])) if totals[s] else 0 for s in totals}
    rest = {s: round(goal[s] - whole[s] * totals[s]) for s in totals}

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["source"].iloc[0]
        s = None if s is None or s != s else s
        take = fit_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), rest[s])
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "extra": take})

    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    plan = stored(histogram.groupBy("source").applyInPandas(fitted, f"source {kinds[source]}, size bigint, extra bigint"))
    facts = spark.createDataFrame([(s, totals[s], goal[s], whole[s]) for s in totals], f"source {kinds[source]}, source_size bigint, target double, whole bigint")
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = ranked(sized, ["source", "size"], order, ["doc_id", "text_hash"]).alias("d")
    out = rows.join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    out = out.join(facts.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")))
    return out.select("d.doc_id", "d.text_hash", "d.source", "d.size", "f.source_size", "f.target", (F.col("f.whole") + (F.col("d.rank") < F.col("p.extra")).cast("long")).alias("copies"))


def op7_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes the whole of documents: doc_id, size, source_size, target, taken."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
