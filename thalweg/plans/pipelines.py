"""The four public tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import flow, neighbour, stats, vector
from ..operators.condition import breach
from ..sources.grid import Grid, check_aligned, check_crs, cut

#: Cells that a stream of the sediment tool drains, whatever the user's threshold is.
NETWORK_CELLS = 250.0


def conditioned(cells: DataFrame, grid: Grid) -> DataFrame:
    """The cells with depressions breached, written once: the steps of a tool read the height many times."""
    done = breach(cells.select(F.lit("dem").alias("raster_id"), "cell_id", "dem"), grid.cols).select("cell_id", F.col("dem").alias("_z"))
    return cut(cells.join(done, "cell_id").withColumn("dem", F.col("_z")).drop("_z"))


def _terrain(cells: DataFrame, grid: Grid, condition: bool) -> DataFrame:
    if condition:
        cells = conditioned(cells, grid)
    slope, acc = neighbour.slope(cells, grid.cols, abs(grid.gt[1])), flow.accumulation(cells, grid.cols)
    return cut(cells.join(slope, "cell_id", "left").join(acc, "cell_id", "left"))


def network_index(cells: DataFrame, grid: Grid, threshold_m2: float = 800_000.0, condition: bool = True) -> DataFrame:
    """cells: (cell_id, row, col, dem). Returns (cell_id, acc, slope, channel, connectivity)."""
    t = _terrain(cells, grid, condition)
    t = t.withColumn("channel", F.coalesce(F.col("acc") > expr.threshold_cells(threshold_m2, grid.gt), F.lit(False)))
    t = t.withColumn("wetness", expr.wetness(F.col("acc"), F.col("slope"), F.lit(1.0)))
    return flow.connectivity(t, grid.cols).select("cell_id", "acc", "slope", "channel", "connectivity")


def sediment_risk(cells: DataFrame, grid: Grid, threshold_m2: float = 800_000.0, stream_power: bool = True, network_cells: float = NETWORK_CELLS, condition: bool = True) -> DataFrame:
    """cells: (cell_id, row, col, dem, lc, rain). Returns (cell_id, acc, channel, connectivity, erosion, risk)."""
    area, mask = expr.cell_area(grid.gt), F.col("dem").isNotNull()
    t = stats.rain_scale(_terrain(cells, grid, condition), "rain", "rain_s", mask)
    t = t.withColumn("channel", F.coalesce(F.col("acc") > network_cells, F.lit(False)) & mask)
    t = t.withColumn("raw", F.when(mask, expr.erosion(F.col("acc"), F.col("slope"), area, stream_power) * F.col("lc")))
    t = stats.percentile_normalise(t, "raw", "erosion")
    t = t.withColumn("wetness", expr.wetness(F.col("acc"), F.col("slope"), F.col("rain_s")))
    t = flow.connectivity(t, grid.cols).withColumn("source", F.col("erosion") * F.col("connectivity"))
    cells_n = expr.threshold_cells(threshold_m2, grid.gt)
    t = t.withColumn("risk", F.when(mask, expr.in_channel_risk(F.col("source"), F.col("acc"), F.col("rain_s"), area, cells_n)))
    t = stats.collapse_guard(t, "risk", "connectivity", "source", F.abs(F.col("acc")) >= cells_n, "risk")
    return t.select("cell_id", "acc", "channel", "connectivity", "erosion", "risk")


def sediment_lines(cells: DataFrame, risk: DataFrame, grid: Grid) -> DataFrame:
    """(line_id, seq, cell_id, x, y, risk): the channel cells of sediment_risk as links with their mean risk.

    cells hold the heights that sediment_risk walked on: conditioned() ones unless its condition was off.
    """
    risk = cut(risk)
    links = vector.cell_centres(flow.stream_links(risk.where("channel"), neighbour.steepest(cells, grid.cols)), grid)
    return links.join(vector.line_mean(links, risk, "risk", grid), "line_id", "left")


def flood_risk(base: DataFrame, layers: DataFrame, grid: Grid | None = None, grids: dict[str, Grid] | None = None) -> DataFrame:
    """base: (cell_id, conn, runoff); layers: (kind, layer_id, cell_id, value). Returns (cell_id, n, mean, stdev).

    The mean is divided by its largest value over all cells; the deviation is not. grids: the named
    inputs' own grids, all of which must be aligned with grid.
    """
    for name, other in (grids or {}).items():
        check_aligned(grid, other, name)
    layers = layers.withColumn("value", expr.decode_flood(F.col("value"), None))
    scored = stats.normalised_layers(layers, stats.check_layers(cut(stats.layer_stats(layers))))
    base = base.select("cell_id", (expr.decode_flood(F.col("conn"), None) * expr.decode_flood(F.col("runoff"), None)).alias("base"))
    return stats.divide_by_max(cut(stats.ensemble(base, scored)), "mean", "mean")


def overland_flow_distance(cells: DataFrame, grid: Grid, points: DataFrame, channels: DataFrame | None = None, snap_distance: float = 100.0, condition: bool = True, points_crs: str = "", channels_crs: str = "") -> DataFrame:
    """cells: (cell_id, row, col, dem); points: (point_id, x, y). Returns (cell_id, distance), NULL if unreached."""
    check_crs(grid, points_crs, "points")
    check_crs(grid, channels_crs, "channels")
    if not cells.where("dem is not null").limit(1).count():
        raise ValueError("the elevation model has no valid cell")
    if not points.limit(1).count():
        raise ValueError("no points are given")
    if condition:
        cells = conditioned(cells, grid)
    if channels is not None:
        points = vector.snap(points, channels, snap_distance)
    succ = neighbour.steepest(cells, grid.cols).select("cell_id", "next_id")
    d = flow.distance(succ, vector.points_to_cells(points, grid), grid.cols, abs(grid.gt[1]), abs(grid.gt[5]))
    return cells.join(d, "cell_id", "left").select("cell_id", expr.clamp_distance(F.col("distance"), F.col("dem").isNotNull()).alias("distance"))
