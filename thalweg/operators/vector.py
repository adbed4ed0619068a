"""Points, snapping to channels, and lines sampled from a raster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..sources.grid import Grid, cut, union


def explode_points(features: DataFrame) -> DataFrame:
    """(feature_id, parts array<struct<x,y>>) to (point_id, x, y); null and empty geometries are skipped."""
    return features.where("parts is not null").select(F.col("feature_id").alias("point_id"), F.explode("parts").alias("p")).where("p is not null").select("point_id", "p.x", "p.y")


def points_to_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Marked cells: points outside land on the edge, and several points on a cell mark it once."""
    col, row = expr.map_to_cell(F.col("x"), F.col("y"), grid.gt)
    return points.select((expr.clamp(row, grid.rows) * grid.cols + expr.clamp(col, grid.cols)).alias("cell_id")).distinct()


def segments(lines: DataFrame) -> DataFrame:
    """(line_id, seq, ax, ay, bx, by) of lines (line_id, seq, x, y)."""
    from pyspark.sql import Window

    w = Window.partitionBy("line_id").orderBy("seq")
    return lines.select("line_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")


def _nearest(points: DataFrame, seg: DataFrame, radius: float, size: float) -> DataFrame:
    """(point_id, px, py, near): the nearest place on the segments that come within radius of a point's bucket.

    Segments are cut into pieces no longer than a bucket; a piece is listed in each bucket that its box
    touches when widened by radius, so whatever lies within radius of a point meets it in its bucket.
    """
    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.hypot(vx, vy) / size))
    cut_up = seg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))

    def reach(a: Column, v: Column) -> Column:
        p, q, wide = a + v * F.col("i") / F.col("n"), a + v * (F.col("i") + 1) / F.col("n"), radius * 1.0001
        return F.sequence(F.floor((F.least(p, q) - wide) / size), F.floor((F.greatest(p, q) + wide) / size))

    listed = cut_up.withColumn("gx", F.explode(reach(F.col("ax"), vx))).withColumn("gy", F.explode(reach(F.col("ay"), vy))).drop("n", "i")
    j = points.withColumn("gx", F.floor(F.col("px") / size)).withColumn("gy", F.floor(F.col("py") / size)).join(listed, ["gx", "gy"], "left")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("ax")) * vx + (F.col("py") - F.col("ay")) * vy, vx * vx + vy * vy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    x, y = F.col("ax") + t * vx, F.col("ay") + t * vy
    near = F.struct(F.hypot(F.col("px") - x, F.col("py") - y).alias("d"), F.col("line_id").cast("long").alias("line"), F.col("seq").cast("long").alias("seq"), x.alias("x"), y.alias("y"))
    return j.groupBy("point_id", "px", "py").agg(F.min(F.when(F.col("line_id").isNotNull(), near)).alias("near"))


def snap(points: DataFrame, lines: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(point_id, x, y, snapped): the nearest place on any segment, or the point itself beyond max_distance.

    0 or None: no limit. Points and segments meet in an equality join on square buckets. With a limit one
    pass settles all; without, the radius is widened for the points that have found nothing within it.
    Points and segments without finite coordinates stay where they are and attract nothing.
    """

    def finite(*cols: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in cols])

    seg = cut(segments(lines).where(finite("ax", "ay", "bx", "by") & F.col("line_id").isNotNull()))
    p = points.select("point_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    left, found = p.where(finite("px", "py")), []
    size = seg.agg(F.count("*").alias("n"), F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("mean"), F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("extent")).first()
    radius = max_distance or max(size.mean or 0.0, (size.extent or 0.0) / max(size.n, 1) ** 0.5) or 1.0
    none = F.lit(None).cast("struct<d:double,line:long,seq:long,x:double,y:double>").alias("near")
    while size.n:
        near = _nearest(left, seg, radius, max(radius, size.mean))
        if max_distance:
            found.append(near)
            break
        near = cut(near)
        found.append(near.where(F.col("near.d") <= radius))
        left = near.where(F.col("near").isNull() | (F.col("near.d") > radius)).select("point_id", "px", "py")
        if not left.limit(1).count():
            break
        radius *= 4
    else:
        found.append(left.select("*", none))
    found.append(p.where(~F.coalesce(finite("px", "py"), F.lit(False))).select("*", none))
    best = union(found)
    far = F.col("near").isNull() | (F.col("near.d") > max_distance if max_distance else F.lit(False))
    return best.select("point_id", F.when(far, F.col("px")).otherwise(F.col("near.x")).alias("x"), F.when(far, F.col("py")).otherwise(F.col("near.y")).alias("y"), (~far).alias("snapped"))


def line_mean(lines: DataFrame, cells: DataFrame, column: str, grid: Grid) -> DataFrame:
    """(line_id, risk): mean of the values under a line's vertices; repeats count, none leaves it unset."""
    col, row = expr.map_to_cell_affine(F.col("x"), F.col("y"), grid.gt)
    v = lines.select("line_id", col.alias("c"), row.alias("r")).where((F.col("c") >= 0) & (F.col("c") < grid.cols) & (F.col("r") >= 0) & (F.col("r") < grid.rows))
    got = v.select("line_id", (F.col("r") * grid.cols + F.col("c")).alias("cell_id")).join(cells.select("cell_id", F.col(column).alias("v")), "cell_id")
    mean = got.groupBy("line_id").agg(F.avg("v").alias("risk"))
    return lines.select("line_id").distinct().join(mean, "line_id", "left")


def cell_centres(df: DataFrame, grid: Grid) -> DataFrame:
    gt, c, r = grid.gt, F.col("cell_id") % grid.cols + 0.5, F.floor(F.col("cell_id") / grid.cols) + 0.5
    return df.withColumn("x", gt[0] + c * gt[1] + r * gt[2]).withColumn("y", gt[3] + c * gt[4] + r * gt[5])
