"""Micro grids whose results were worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import expr
from thalweg.operators import flow, neighbour, stats, vector
from thalweg.operators.condition import breach_array
from thalweg.plans import pipelines
from thalweg.sources import grid as g
from thalweg.sources.grid import Grid, check_aligned, check_outputs


def grid(spark, rows):
    cols = len(rows[0])
    data = [(r * cols + c, r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(data, "cell_id long, row long, col long, dem double")


def successors(spark, rows):
    return {r.cell_id: r.next_id for r in neighbour.steepest(grid(spark, rows), len(rows[0])).collect()}


def test_ramp_flows_east_and_traces_the_running_minimum(spark):
    assert successors(spark, [[5, 4, 3, 2, 1]]) == {0: 1, 1: 2, 2: 3, 3: 4, 4: None}
    cells = spark.createDataFrame([(0, 5.0, 1, False), (1, 2.0, 2, False), (2, 9.0, 3, False), (3, 1.0, None, False)], "cell_id long, value double, next_id long, terminal boolean")
    assert {r.cell_id: r.value for r in flow.trace_min(cells).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}


def test_trace_ends_with_the_first_channel_cell(spark):
    cells = spark.createDataFrame([(0, 5.0, 1, False), (1, 2.0, 2, True), (2, 1.0, None, False)], "cell_id long, value double, next_id long, terminal boolean")
    assert {r.cell_id: r.value for r in flow.trace_min(cells).collect()} == {0: 2.0, 1: 1.0, 2: 1.0}


def test_pit_flat_tie_and_masked_neighbour(spark):
    assert successors(spark, [[5, 5, 5], [5, 1, 5], [5, 5, 5]])[4] is None
    assert set(successors(spark, [[1, 1, 1]] * 3).values()) == {None}
    assert successors(spark, [[9, 1, 9], [9, 5, 1], [9, 9, 9]])[4] == 1
    assert successors(spark, [[4, 3], [2, None]])[1] == 2


def test_flat_raster_normalises_to_zero(spark):
    out = stats.percentile_normalise(grid(spark, [[7, 7], [7, None]]), "dem", "v").orderBy("cell_id").collect()
    assert [r.v for r in out] == [0.0, 0.0, 0.0, None]


def test_percentiles_by_rank_search_equal_the_aggregate(spark, monkeypatch):
    df = spark.range(5000).select((F.rand(3) * 100).alias("v"))
    df = df.checkpoint()
    exact = stats.percentiles(df, "v", [0.05, 0.5, 0.95])
    monkeypatch.setattr(stats, "HELD", 300)
    assert stats.percentiles(df, "v", [0.05, 0.5, 0.95]) == pytest.approx(exact)


@pytest.mark.parametrize("top", [2, 40])
def test_percentiles_of_values_that_repeat(spark, monkeypatch, top):
    df = spark.range(4000).select((F.col("id") * F.col("id") % top).cast("double").alias("v"))
    exact = stats.percentiles(df, "v", [0.05, 0.5, 0.95])
    monkeypatch.setattr(stats, "HELD", 50)
    assert stats.percentiles(df, "v", [0.05, 0.5, 0.95]) == pytest.approx(exact)


def test_medians_of_large_layers_equal_the_grouping(spark, monkeypatch):
    df = spark.range(900).select(F.lit("rain").alias("kind"), F.when(F.col("id") < 800, 1).otherwise(2).alias("layer_id"), F.col("id").alias("cell_id"), (F.col("id") * 37 % 611).cast("double").alias("value"))
    exact = sorted(map(tuple, stats.layer_stats(df).collect()))
    monkeypatch.setattr(stats, "HELD", 200)
    assert sorted(map(tuple, stats.layer_stats(df).collect())) == exact


def test_stretch_where_the_median_is_the_least_value(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    got = v.select(expr.peak_at_median(F.col("v"), F.lit(1.0), F.lit(1.0), F.lit(3.0)).alias("s")).collect()
    assert [r.s for r in got] == [1.0, 0.5, None]


def test_ensemble_counts_pairs_of_valid_layers(spark):
    base = spark.createDataFrame([(0, 2.0), (1, None)], "cell_id long, base double")
    scored = spark.createDataFrame([("rain", 1, 0, 0.5), ("rain", 2, 0, None), ("ofd", 1, 0, 1.0), ("ofd", 2, 0, 0.25)], "kind string, layer_id int, cell_id long, score double")
    for fn in (stats.ensemble, stats.ensemble_pairs):
        r = {x.cell_id: x for x in fn(base, scored).collect()}
        assert r[0].n == 2 and r[0].mean == pytest.approx(0.625) and r[0].stdev == pytest.approx(0.375) and r[1].n == 0 and r[1].mean is None


def test_layers_without_spread_are_errors(spark):
    flat = spark.createDataFrame([("rain", 1, 0, 3.0), ("rain", 1, 1, 3.0)], "kind string, layer_id int, cell_id long, value double")
    with pytest.raises(ValueError, match="equal"):
        stats.check_layers(stats.layer_stats(flat))


def test_distance_and_unreached_cells(spark):
    cells = grid(spark, [[3, 2, 1, 5]])
    d = flow.distance(neighbour.steepest(cells, 4), spark.createDataFrame([(1,)], "cell_id long"), 4)
    assert {r.cell_id: r.distance for r in d.collect()} == {0: 1.0, 1: 0.0, 2: None, 3: None}


def test_accumulation_reaches_the_sink_in_full(spark):
    acc = {r.cell_id: r.acc for r in flow.accumulation(grid(spark, [[3, 2, 1]]), 3).collect()}
    assert acc == {0: 1.0, 1: 2.0, 2: 3.0}


def test_points_outside_land_on_the_edge_and_mark_once(spark):
    p = spark.createDataFrame([(1, -5.0, 5.0), (2, 0.2, -0.2), (3, 99.0, -99.0)], "point_id long, x double, y double")
    assert sorted(r[0] for r in vector.points_to_cells(p, Grid(3, 3)).collect()) == [0, 8]


def test_snap_keeps_far_points(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0)], "line_id long, seq int, x double, y double")
    p = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 9.0)], "point_id long, x double, y double")
    got = {r.point_id: (r.x, r.y, r.snapped) for r in vector.snap(p, lines, 2.0).collect()}
    assert got == {1: (3.0, 0.0, True), 2: (3.0, 9.0, False)}


@pytest.mark.parametrize("limit", [None, 4.0])
def test_snap_equals_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    ends, at = rng.uniform(-40, 40, (30, 2, 2)), np.vstack([rng.uniform(-50, 50, (60, 2)), [[900.0, -700.0]]])
    lines = spark.createDataFrame([(i, k, float(x), float(y)) for i, e in enumerate(ends) for k, (x, y) in enumerate(e)], "line_id long, seq int, x double, y double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(99, None, 1.0)], "point_id long, x double, y double")
    got = {r.point_id: r for r in vector.snap(p, lines, limit).collect()}
    assert len(got) == 62 and not got[99].snapped
    for i, q in enumerate(at):
        v = ends[:, 1] - ends[:, 0]
        t = np.clip(((q - ends[:, 0]) * v).sum(1) / (v * v).sum(1), 0, 1)
        near = ends[:, 0] + t[:, None] * v
        d = np.hypot(*(q - near).T)
        snapped = limit is None or d.min() <= limit
        assert got[i].snapped == snapped
        assert (got[i].x, got[i].y) == pytest.approx(tuple(near[d.argmin()] if snapped else q))


def test_snap_without_lines(spark):
    p = spark.createDataFrame([(1, 3.0, 1.0)], "point_id long, x double, y double")
    none = spark.createDataFrame([], "line_id long, seq int, x double, y double")
    assert [tuple(r) for r in vector.snap(p, none, None).collect()] == [(1, 3.0, 1.0, False)]


def test_links_break_at_junctions(spark):
    succ = spark.createDataFrame([(0, 2), (1, 2), (2, 3), (3, None)], "cell_id long, next_id long")
    got = sorted((r.line_id, r.seq, r.cell_id) for r in flow.stream_links(succ.select("cell_id"), succ).collect())
    assert got == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 2), (2, 0, 2), (2, 1, 3)]


def test_breaching_lets_every_cell_drain():
    out = breach_array(np.array([[5.0, 5, 5, 5], [5, 1, 4, 3], [5, 5, 5, 5]]))
    assert out[1, 2] <= out[1, 1] and out[1, 3] <= out[1, 2]


def _basin(spark):
    rng = np.random.default_rng(11)
    dem = rng.uniform(0, 9, (7, 8)) + np.abs(np.arange(8) - 3)[None, :]
    dem[3, 3] = -5.0
    plain, done = grid(spark, dem.tolist()), grid(spark, breach_array(dem).tolist())
    return plain, done, Grid(8, 7)


def test_tools_walk_on_breached_heights(spark):
    plain, done, grid_ = _basin(spark)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    extra = {"lc": (F.col("cell_id") % 5 + 1) / 5, "rain": 500.0 + F.col("cell_id") % 3}
    points = spark.createDataFrame([(1, 3.5, -0.5), (2, 0.5, -6.5)], "point_id long, x double, y double")
    for tool in (
        lambda c, **k: pipelines.network_index(c, grid_, 5.0, **k),
        lambda c, **k: pipelines.sediment_risk(c.withColumns(extra), grid_, 3.0, network_cells=5.0, **k),
        lambda c, **k: pipelines.overland_flow_distance(c, grid_, points, **k),
    ):
        for a, b in zip(rows(tool(plain)), rows(tool(done, condition=False)), strict=True):
            assert [x is None for x in a] == [x is None for x in b]
            assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None])


def test_accumulation_is_the_same_when_frontiers_are_added_early(spark, monkeypatch):
    plain, _, grid_ = _basin(spark)
    want = {r.cell_id: r.acc for r in flow.accumulation(plain, grid_.cols).collect()}
    monkeypatch.setattr(flow, "FRONTIERS", 2)
    got = {r.cell_id: r.acc for r in flow.accumulation(plain, grid_.cols).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("side", [1, 3, 256])
def test_accumulation_by_tiles_equals_brute_force(spark, monkeypatch, side):
    rng = np.random.default_rng(11)
    dem = rng.permutation(90).reshape(9, 10).astype(float) + np.arange(10) * 9.0
    dem[4, 3:6] = np.nan
    want = {k: 1.0 for k in range(90) if not np.isnan(dem.flat[k])}
    for k in sorted(want, key=lambda k: -dem.flat[k]):
        r, c = divmod(k, 10)
        falls = {}
        for dr, dc in expr.OFFSETS:
            if 0 <= r + dr < 9 and 0 <= c + dc < 10 and dem[r + dr, c + dc] < dem[r, c]:
                falls[(r + dr) * 10 + c + dc] = ((dem[r, c] - dem[r + dr, c + dc]) / np.hypot(dr, dc)) ** 2
        for to, g in falls.items():
            want[to] += want[k] * g / sum(falls.values())
    monkeypatch.setattr(flow, "TILE", side)
    cells = grid(spark, [[None if np.isnan(v) else float(v) for v in row] for row in dem])
    assert {r.cell_id: r.acc for r in flow.accumulation(cells, 10).collect()} == pytest.approx(want)


def test_accumulation_of_nothing_and_of_a_circle(spark):
    empty = spark.createDataFrame([], "cell_id long, row int, col int, dem double")
    assert flow.accumulation(empty, 4).count() == 0
    circle = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    with pytest.raises(Exception, match="flow runs in a circle"):
        flow.accumulate(grid(spark, [[2, 1]]), circle, 2).count()


def test_files_of_grids_and_lines(spark, tmp_path):
    path = tmp_path / "a.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n1 2 3\n4 5 -9999\n")
    read, cells = g.read_ascii_grid(spark, str(path))
    assert (read.cols, read.rows, read.gt, read.nodata) == (3, 2, (10.0, 5.0, 0.0, 30.0, 0.0, -5.0), -9999.0)
    assert [r.value for r in cells.orderBy("cell_id").collect()] == [1, 2, 3, 4, 5, -9999]
    out = str(tmp_path / "raster")
    g.write_raster(cells.withColumn("value", expr.decode_exact(F.col("value"), read.nodata)), out, "value")
    assert [r.value for r in g.read_cells(spark, out).orderBy("cell_id").collect()] == [1, 2, 3, 4, 5, -9999]
    lines = spark.createDataFrame([(1, 1, 2.0, 0.0, 0.5), (1, 0, 1.0, 0.0, 0.5)], "line_id long, seq int, x double, y double, risk double")
    g.write_lines(lines, str(tmp_path / "lines"))
    assert [(r.line_id, r.risk, r.wkt) for r in spark.read.parquet(str(tmp_path / "lines")).collect()] == [(1, 0.5, "LINESTRING (1.0 0.0, 2.0 0.0)")]
    both = g.stack_layers([("rain", 1, cells), ("ofd", 2, cells)])
    assert both.count() == 12 and both.columns == ["kind", "layer_id", "cell_id", "value"]
    with pytest.raises(ValueError, match="no layers"):
        g.stack_layers([])


def test_differing_reference_systems_are_refused(spark):
    plain, _, _ = _basin(spark)
    here = Grid(8, 7, crs="EPSG:27700")
    points = spark.createDataFrame([(1, 3.5, -0.5)], "point_id long, x double, y double")
    with pytest.raises(ValueError, match="reference system"):
        pipelines.overland_flow_distance(plain, here, points, points_crs="EPSG:4326")
    with pytest.raises(ValueError, match="reference system"):
        check_aligned(here, Grid(8, 7, crs="EPSG:4326"), "rain")
    with pytest.raises(ValueError, match="rain: its size"):
        pipelines.flood_risk(plain, plain, here, {"rain": Grid(8, 6)})


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        check_aligned(Grid(2, 2), Grid(2, 3), "rain")
    with pytest.raises(ValueError):
        check_outputs(a="x", b="x")
    with pytest.raises(ValueError):
        Grid(0, 1)
