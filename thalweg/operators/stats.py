"""Global statistics over cells, and what is normalised by them. One-row results are joined by broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

#: Values that one aggregate may hold for exact percentiles; above, ranks are searched in rounds.
HELD = 5_000_000


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation over non-null values, at any size.

    Beyond HELD values, each needed rank is bracketed by approximate percentiles of what is left,
    until a bracket is small enough to sort. A rank outside its bracket is sought in a wider one, and
    values that repeat at a bracket's ends are counted instead of kept.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null")
    n = values.count()
    if not n:
        return [None] * len(shares)
    if n <= HELD:
        return values.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]

    def at(rank: int) -> float:
        part, below, size, width = values, 0, n, 0.001
        while size > HELD:
            q = (rank - below) / size
            lo, hi = part.approxQuantile("v", [max(0.0, q - width), min(1.0, q + width)], 0.0005)
            v, k = F.col("v"), rank - below
            under, low, between, high = part.agg(F.count_if(v < lo), F.count_if(v == lo), F.count_if((v > lo) & (v < hi)), F.count_if(v == hi)).first()
            if not under <= k < under + low + between + (high if hi > lo else 0):
                width *= 4
                continue
            if k < under + low:
                return lo
            if k >= under + low + between:
                return hi
            part, below, size = part.where((v > lo) & (v < hi)), below + under + low, between
        return part.agg(F.sort_array(F.collect_list("v"))[rank - below]).first()[0]

    out = []
    for s in shares:
        k = s * (n - 1)
        a, b = at(int(k)), at(min(n - 1, int(k) + 1))
        out.append(a + (b - a) * (k - int(k)))
    return out


def percentile_normalise(df: DataFrame, column: str, out: str, lo: float = 0.05, hi: float = 0.95, within: Column | None = None) -> DataFrame:
    """(v - p5) / (p95 - p5), clipped to [0, 1]; equal percentiles count as one apart."""
    v = F.col(column) if within is None else F.when(within, F.col(column))
    a, b = percentiles(df.select(v.alias("v")), "v", [lo, hi])
    if a is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    b = a + 1 if b <= a else b
    return df.withColumn(out, expr.clip((v - a) / (b - a), 0.0, 1.0))


def rain_scale(df: DataFrame, column: str, out: str, mask: Column) -> DataFrame:
    """rain over its mean within the mask (over all cells, if the mask is empty); a mean of 0 counts as 1."""
    r = F.col(column)
    m = df.agg(F.when(F.count_if(mask) > 0, F.avg(F.when(mask, r))).otherwise(F.avg(r)).alias("_m"))
    scale = F.when(F.col("_m").isNull() | (F.col("_m") == 0), F.lit(1.0)).otherwise(F.col("_m"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, r / scale).drop("_m")


def coverage(df: DataFrame, column: str, mask: Column) -> DataFrame:
    v = F.col(column).isNotNull()
    return df.agg(F.count_if(mask).alias("n_mask"), F.count_if(mask & v).alias("n_finite"), F.try_divide(F.count_if(mask & v).cast("double"), F.count_if(mask)).alias("ratio"))


def layer_stats(layers: DataFrame, median: bool = True) -> DataFrame:
    """min, max, count and exact median of each layer.

    One grouping holds the values of layers up to HELD; a larger layer's median is searched by rank.
    """
    cols = [F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")]
    out = layers.groupBy("kind", "layer_id").agg(*cols)
    if not median:
        return out
    large = [(r.kind, r.layer_id) for r in out.where(F.col("n") > HELD).collect()]
    if not large:
        return layers.groupBy("kind", "layer_id").agg(*cols, F.median("value").alias("mid"))

    def one(kind: str, number: int) -> Column:
        return F.col("kind").eqNullSafe(F.lit(kind)) & F.col("layer_id").eqNullSafe(F.lit(number))

    held = reduce(lambda a, b: a & b, [~one(*x) for x in large])
    found = out.select("*", F.lit(None).cast("double").alias("mid")).where(~held)
    for kind, number in large:
        mid = percentiles(layers.where(one(kind, number)), "value", [0.5])[0]
        found = found.withColumn("mid", F.when(one(kind, number), F.lit(mid)).otherwise(F.col("mid")))
    return layers.where(held).groupBy("kind", "layer_id").agg(*cols, F.median("value").alias("mid")).unionByName(found)


def check_layers(stats: DataFrame) -> DataFrame:
    """Raises where a layer has no values, one value only, or a zero median of distances."""
    for r in stats.collect():
        name = f"{r.kind} layer {r.layer_id}"
        if not r.n:
            raise ValueError(f"{name} has no valid data")
        if r.lo == r.hi:
            raise ValueError(f"{name}: its least and largest values are equal")
        if r.kind == "ofd" and r.mid == 0:
            raise ValueError(f"{name}: its median is zero")
    return stats


def normalised_layers(layers: DataFrame, stats: DataFrame) -> DataFrame:
    """Rain layers by least and largest value, distance layers by their peak at the median: adds score."""
    j = layers.join(F.broadcast(stats), ["kind", "layer_id"])
    rain = expr.rain_normalise(F.col("value"), F.col("lo"), F.col("hi"))
    ofd = expr.peak_at_median(F.col("value"), F.col("lo"), F.col("mid"), F.col("hi"))
    return j.select("kind", "layer_id", "cell_id", F.when(F.col("kind") == "rain", rain).otherwise(ofd).alias("score"))


def ensemble(base: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean and population deviation of base * rain * distance over all pairs of layers.

    Validity of the two is independent at a cell, so sums over pairs factor into sums over layers: two
    sums a cell instead of a row for each pair.
    """
    s = F.col("score")
    def sums(kind: str, p: str) -> list[Column]:
        v = F.when(F.col("kind") == kind, s)
        return [F.count(v).alias(f"n{p}"), F.sum(v).alias(f"s{p}"), F.sum(v * v).alias(f"q{p}")]

    per = scored.groupBy("cell_id").agg(*sums("rain", "r"), *sums("ofd", "o"))
    j = base.select("cell_id", "base").join(per, "cell_id", "left")
    n = F.when(F.col("base").isNotNull(), F.coalesce(F.col("nr") * F.col("no"), F.lit(0))).otherwise(0)
    mean = F.when(n > 0, F.col("base") * F.col("sr") * F.col("so") / n)
    var = F.when(n > 0, F.col("base") * F.col("base") * F.col("qr") * F.col("qo") / n - mean * mean)
    return j.select("cell_id", n.cast("long").alias("n"), mean.alias("mean"), F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("stdev"))


def ensemble_pairs(base: DataFrame, scored: DataFrame) -> DataFrame:
    """The same from a row for each pair of layers: the check of ensemble()."""
    r = scored.where("kind = 'rain'").select("cell_id", F.col("score").alias("r"))
    o = scored.where("kind = 'ofd'").select("cell_id", F.col("score").alias("o"))
    p = base.select("cell_id", "base").join(r, "cell_id", "left").join(o, "cell_id", "left").withColumn("p", F.col("base") * F.col("r") * F.col("o"))
    return p.groupBy("cell_id").agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("stdev"))


def divide_by_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Raises where there is no largest value, or it is 0."""
    top = df.agg(F.max(column)).first()[0]
    if not top:
        raise ValueError("the ensemble's largest mean is zero or missing")
    return df.withColumn(out, F.col(column) / F.lit(float(top)))


def collapse_guard(df: DataFrame, risk: str, conn: str, source: str, stream: Column, out: str) -> DataFrame:
    """Where risk equals connectivity on all stream cells, risk becomes the source risk there."""
    top = df.where(stream).agg(F.max(F.abs(F.col(risk) - F.col(conn)))).first()[0]
    if top is not None and top < 1e-6:
        return df.withColumn(out, F.when(stream, F.col(source)))
    return df.withColumn(out, F.col(risk))
