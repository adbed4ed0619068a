"""Neighbourhood operators: offsets are exploded first, so that neighbours meet in an equality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import D8_CODES, OFFSETS



def _around(cells: DataFrame, cols: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(2**0.5 if dr and dc else 1.0).alias("dist")) for k, (dr, dc) in enumerate(OFFSETS)])
    x = cells.where("dem is not null").select(F.col("cell_id").alias("src"), "row", "col", F.col("dem").alias("z0"), F.explode(steps).alias("s"))
    x = x.withColumn("nr", F.col("row") + F.col("s.dr")).withColumn("nc", F.col("col") + F.col("s.dc")).where((F.col("nr") >= 0) & (F.col("nc") >= 0) & (F.col("nc") < cols))
    return x.select("src", "z0", F.col("s.k").alias("k"), F.col("s.dist").alias("dist"), (F.col("nr") * cols + F.col("nc")).cast("long").alias("dst"))


def edges(cells: DataFrame, cols: int) -> DataFrame:
    """(src, dst, k, dist, z0, z): pairs of valid neighbours; dist in cells, k the offset's number."""
    z = cells.where("dem is not null").select(F.col("cell_id").alias("dst"), F.col("dem").alias("z"))
    return _around(cells, cols).join(z, "dst").select("src", "dst", "k", "dist", "z0", "z")


def steepest(cells: DataFrame, cols: int) -> DataFrame:
    """(cell_id, next_id, k): the strictly lower neighbour of the largest gradient; the first offset wins ties."""
    g = (F.col("z0") - F.col("z")) / F.col("dist")
    best = edges(cells, cols).withColumn("g", g).where("g > 0").groupBy("src").agg(F.min_by(F.struct("dst", "k"), F.struct((-F.col("g")).alias("g"), F.col("k"))).alias("b"))
    out = cells.where("dem is not null").select("cell_id").join(best, F.col("cell_id") == F.col("src"), "left")
    return out.select("cell_id", F.col("b.dst").alias("next_id"), F.col("b.k").alias("k"))


def d8_code(successors: DataFrame) -> DataFrame:
    codes = F.create_map(*[x for k, c in enumerate(D8_CODES) for x in (F.lit(k), F.lit(c))])
    return successors.select("cell_id", F.coalesce(F.try_element_at(codes, F.col("k")), F.lit(0)).alias("code"))


def d8_decode(cells: DataFrame, cols: int) -> DataFrame:
    """(cell_id, next_id) from a code column; outside, invalid targets and other codes have none.

    Whether the source itself is valid isn't asked, nor are two cells that point at each other.
    """
    offset = F.create_map(*[x for k, c in enumerate(D8_CODES) for x in (F.lit(c), F.struct(F.lit(OFFSETS[k][0]).alias("dr"), F.lit(OFFSETS[k][1]).alias("dc")))])
    o = F.try_element_at(offset, F.col("code"))
    to = cells.withColumn("nr", F.col("row") + o["dr"]).withColumn("nc", F.col("col") + o["dc"])
    to = to.withColumn("to", F.when((F.col("nr") >= 0) & (F.col("nc") >= 0) & (F.col("nc") < cols), F.col("nr") * cols + F.col("nc")).cast("long"))
    valid = cells.where("dem is not null").select(F.col("cell_id").alias("next_id"))
    return to.join(valid, F.col("to") == F.col("next_id"), "left").select("cell_id", "next_id")


def slope(cells: DataFrame, cols: int, cell_size: float = 1.0) -> DataFrame:
    """(cell_id, slope): Horn's gradient in degrees; a missing neighbour has the cell's own height."""
    e = edges(cells, cols).groupBy("src").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}n") for k in range(8)])
    j = cells.where("dem is not null").select("cell_id", "dem").join(e, F.col("cell_id") == F.col("src"), "left")
    n, ne, east, se, s, sw, w, nw = [F.coalesce(F.col(f"z{k}n"), F.col("dem")) for k in range(8)]
    dx = ((ne + 2 * east + se) - (nw + 2 * w + sw)) / (8 * cell_size)
    dy = ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * cell_size)
    return j.select("cell_id", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))


def flow_weights(cells: DataFrame, cols: int, exponent: float = 2.0) -> DataFrame:
    """(src, dst, w): shares of flow to lower neighbours, by gradient to the exponent; they add up to 1."""
    e = edges(cells, cols).where("z0 > z").withColumn("g", F.pow((F.col("z0") - F.col("z")) / F.col("dist"), F.lit(exponent)))
    total = e.groupBy("src").agg(F.sum("g").alias("t"))
    return e.join(total, "src").select("src", "dst", (F.col("g") / F.col("t")).alias("w"))
