"""Iterative operators over flow graphs: pointer doubling and accumulation by tiles."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grid import cut, union
from . import neighbour
from .stats import percentile_normalise

#: Rounds whose results accumulate() keeps apart before it adds them up.
FRONTIERS = 32
#: Side of the square of cells that one task of accumulate() holds.
TILE = 256


def trace_start(cells: DataFrame) -> DataFrame:
    """cells: (cell_id, value, next_id, terminal). Value, next and done before any doubling.

    Without a successor a cell is done; a terminal successor is the last that counts.
    """
    to = cells.select(F.col("cell_id").alias("_to"), F.col("value").alias("_v"), F.col("terminal").alias("_t"))
    j = cells.join(to, F.col("next_id") == F.col("_to"), "left")
    none, last = F.col("_to").isNull(), F.coalesce("_t", F.lit(False))
    return j.select("cell_id", F.when(last, F.least("value", "_v")).otherwise(F.col("value")).alias("value"), F.when(~none & ~last, F.col("next_id")).alias("next_id"), (none | last).alias("done"))


def trace_min(cells: DataFrame) -> DataFrame:
    """(cell_id, value): the least value along each cell's path, up to the first terminal successor.

    Pointer doubling: a path of L cells takes about log2 L rounds, each of which joins and writes only the
    cells whose path goes on. Cycles end at the round limit with what they have.
    """
    state = cut(trace_start(cells))
    n = state.count()
    done, active = [state.where("done")], state.where("not done")
    for _ in range(max(1, math.ceil(math.log2(max(n, 2))) + 2)):
        if not active.limit(1).count():
            break
        to = union([*done, active]).select(F.col("cell_id").alias("_to"), F.col("value").alias("_v"), F.col("next_id").alias("_n"), F.col("done").alias("_d"))
        j = active.join(to, F.col("next_id") == F.col("_to"), "left")
        new = cut(j.select("cell_id", F.least("value", "_v").alias("value"), F.col("_n").alias("next_id"), F.coalesce("_d", F.lit(True)).alias("done")))
        done, active = [*done, new.where("done")], new.where("not done")
    return union([*done, active]).select("cell_id", "value")


def distance(successors: DataFrame, targets: DataFrame, cols: int, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """(cell_id, distance): length of the path to the first target; NULL where none lies downstream."""
    t = targets.select(F.col("cell_id").alias("_t")).distinct()
    s = successors.join(t, F.col("cell_id") == F.col("_t"), "left").withColumn("hit", F.col("_t").isNotNull())
    dc, dr = (F.col("next_id") % cols - F.col("cell_id") % cols) * dx, (F.floor(F.col("next_id") / cols) - F.floor(F.col("cell_id") / cols)) * dy
    step = F.when(F.col("hit") | F.col("next_id").isNull(), F.lit(0.0)).otherwise(F.hypot(dc.cast("double"), dr.cast("double")))
    state = cut(s.select("cell_id", step.alias("d"), F.when(~F.col("hit"), F.col("next_id")).alias("next_id"), "hit"))
    n = state.count()
    done, active = [state.where("next_id is null")], state.where("next_id is not null")
    for _ in range(max(1, math.ceil(math.log2(max(n, 2))) + 2)):
        if not active.limit(1).count():
            break
        to = union([*done, active]).select(F.col("cell_id").alias("_to"), F.col("d").alias("_d"), F.col("next_id").alias("_n"), F.col("hit").alias("_h"))
        j = active.join(to, F.col("next_id") == F.col("_to"), "left")
        new = cut(j.select("cell_id", (F.col("d") + F.coalesce("_d", F.lit(0.0))).alias("d"), F.col("_n").alias("next_id"), F.coalesce("_h", F.lit(False)).alias("hit")))
        done, active = [*done, new.where("next_id is null")], new.where("next_id is not null")
    return union([*done, active]).select("cell_id", F.when(F.col("hit"), F.col("d")).alias("distance"))


def _through_tile(tile_of):
    """Kernel: takes the flow that enters a tile down to its sinks and edges, each cell once all above it are done.

    Rows inside tell what passed each cell; the others what leaves for cells of other tiles.
    """
    schema = pa.schema([("cell_id", pa.int64()), ("f", pa.float64()), ("inside", pa.bool_())])

    def run(key: tuple, entering: pa.Table, weights: pa.Table) -> pa.Table:
        cell, f = entering["cell_id"].to_numpy(), entering["f"].to_numpy()
        if not len(cell):
            return schema.empty_table()
        src, dst, w = (weights[c].to_numpy() for c in ("src", "dst", "w"))
        inner = tile_of(dst) == key[0].as_py()
        nodes = np.unique(np.concatenate([cell, src, dst[inner]]))
        total = np.bincount(np.searchsorted(nodes, cell), weights=f, minlength=len(nodes))
        s, d, share = np.searchsorted(nodes, src[inner]), np.searchsorted(nodes, dst[inner]), w[inner]
        order = np.argsort(s, kind="stable")
        s, d, share = s[order], d[order], share[order]
        first = np.searchsorted(s, np.arange(len(nodes) + 1))
        above = np.bincount(d, minlength=len(nodes))
        ready, seen = np.flatnonzero(above == 0), 0
        while len(ready):
            seen += len(ready)
            n = first[ready + 1] - first[ready]
            at = np.repeat(first[ready] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.add.at(total, d[at], total[s[at]] * share[at])
            np.subtract.at(above, d[at], 1)
            below = np.unique(d[at])
            ready = below[above[below] == 0]
        if seen < len(nodes):
            raise ValueError("flow runs in a circle")
        away, where = np.unique(dst[~inner], return_inverse=True)
        out = np.bincount(where, weights=total[np.searchsorted(nodes, src[~inner])] * w[~inner], minlength=len(away))
        held, left = total > 0, out > 0
        rows = [np.concatenate(x) for x in ((nodes[held], away[left]), (total[held], out[left]))]
        return pa.table([*rows, np.arange(len(rows[0])) < held.sum()], schema=schema)

    return run


def accumulate(cells: DataFrame, weights: DataFrame, cols: int) -> DataFrame:
    """(cell_id, acc): each cell's own unit and all that flows into it, tile by tile.

    A round takes the flow that enters a tile through the whole of it and hands what leaves to the next
    round, so that rounds are as many as the tiles that the longest path enters, and a task holds one
    tile. Every other round shifts the tiles by half their side, lest flow along an edge cross it again
    and again. What passed a cell is added up at the end, and whenever FRONTIERS rounds have gathered. Only
    tiles that flow enters take part in a round. Weights must run downhill: a circle within a tile raises
    an error.
    """
    side, wide = TILE, cols // TILE + 2

    def tile_of(cell, shift: int):
        """Number of a cell's tile; wide leaves room for the shift."""
        return (cell // cols + shift) // side * wide + (cell % cols + shift) // side

    def tiled(df: DataFrame, column: str, shift: int) -> DataFrame:
        return df.withColumn("tile", F.expr(f"({column} div {cols} + {shift}) div {side} * {wide} + ({column} % {cols} + {shift}) div {side}"))

    weights = cut(weights)
    frontier = cells.where("dem is not null and cell_id is not null").select("cell_id", F.lit(1.0).alias("f"))
    parts, shift = [], 0

    def total() -> DataFrame:
        return union(parts).groupBy("cell_id").agg(F.sum("f").alias("f"))

    while True:
        entering, own = tiled(frontier, "cell_id", shift), tiled(weights, "src", shift)
        if parts:
            own = own.join(entering.select("tile").distinct(), "tile", "left_semi")
        kernel = _through_tile(partial(tile_of, shift=shift))
        moved = cut(entering.groupBy("tile").cogroup(own.groupBy("tile")).applyInArrow(kernel, "cell_id bigint, f double, inside boolean"))
        parts.append(moved.where("inside").select("cell_id", "f"))
        if not moved.where("not inside").limit(1).count():
            break
        if len(parts) > FRONTIERS:
            parts = [cut(total())]
        frontier = moved.where("not inside").groupBy("cell_id").agg(F.sum("f").alias("f"))
        shift = side // 2 - shift
    return total().withColumnRenamed("f", "acc")


def accumulation(cells: DataFrame, cols: int, exponent: float = 2.0) -> DataFrame:
    return accumulate(cells, neighbour.flow_weights(cells, cols, exponent), cols)


def connectivity(cells: DataFrame, cols: int) -> DataFrame:
    """cells: (cell_id, row, col, dem, wetness, channel). Adds connectivity, 0 to 1 over valid cells."""
    valid = cells.where("dem is not null and wetness is not null")
    succ = neighbour.steepest(valid, cols).select("cell_id", "next_id")
    traced = trace_min(valid.select("cell_id", F.col("wetness").alias("value"), F.col("channel").alias("terminal")).join(succ, "cell_id"))
    out = percentile_normalise(traced, "value", "connectivity")
    return cells.join(out.select("cell_id", "connectivity"), "cell_id", "left")


def stream_links(streams: DataFrame, successors: DataFrame) -> DataFrame:
    """(line_id, seq, cell_id): stream cells in links from a head or junction down to the next junction.

    A link is named by its first cell and ends on the junction below it, if there is one. Cells find
    their link's first cell by pointer doubling upstream.
    """
    s = streams.select("cell_id").join(successors.select("cell_id", "next_id"), "cell_id", "left")
    ids = streams.select(F.col("cell_id").alias("_n"))
    s = s.join(ids, F.col("next_id") == F.col("_n"), "left").select("cell_id", F.col("_n").alias("next_id"))
    up = s.where("next_id is not null").groupBy("next_id").agg(F.count("*").alias("n"), F.max("cell_id").alias("from")).withColumnRenamed("next_id", "_c")
    j = s.join(up, F.col("cell_id") == F.col("_c"), "left")
    one = F.coalesce("n", F.lit(0)) == 1
    state = cut(j.select("cell_id", "next_id", F.when(one, F.col("from")).otherwise(F.col("cell_id")).alias("root"), F.when(one, 1).otherwise(0).cast("long").alias("seq"), (~one).alias("start")))
    links = state.select("cell_id", "next_id", "start")
    state = state.select("cell_id", "root", "seq", F.col("start").alias("done"))
    done, active = [state.where("done")], state.where("not done")
    for _ in range(64):
        if not active.limit(1).count():
            break
        to = union([*done, active]).select(F.col("cell_id").alias("_to"), F.col("root").alias("_r"), F.col("seq").alias("_s"), F.col("done").alias("_d"))
        new = cut(active.join(to, F.col("root") == F.col("_to")).select("cell_id", F.col("_r").alias("root"), (F.col("seq") + F.col("_s")).alias("seq"), F.col("_d").alias("done")))
        done, active = [*done, new.where("done")], new.where("not done")
    own = union([*done, active]).select(F.col("root").alias("line_id"), "seq", "cell_id")
    starts = links.where("start").select(F.col("cell_id").alias("_st"))
    ends = own.join(links.select(F.col("cell_id").alias("_c"), F.col("next_id")), F.col("cell_id") == F.col("_c")).join(starts, F.col("next_id") == F.col("_st"))
    return own.unionByName(ends.select("line_id", (F.col("seq") + 1).alias("seq"), F.col("next_id").alias("cell_id")))
