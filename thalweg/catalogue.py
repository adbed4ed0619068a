"""Registered queries and their SQL for the terrain and risk operators. Floats are rounded to six places in both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import expr
from .operators import condition, flow, neighbour, stats, vector
from .plans import pipelines
from .sources import grid as g

GT = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
WORDS = {"No valid cells": {"de": "Keine gueltigen Zellen", "es": "Sin celdas validas"}, "Done": {"de": "Fertig"}}

_QUERIES: dict = {}
_SQL: dict = {}

#: Named SQL steps; a query's SQL names those that it needs, in order.
STEPS = {
    "stack": fx.STACK.format(div="//"),
    "layers": fx.LAYERS,
    "parts": fx.PARTS.format(div="//"),
    "points": fx.POINTS,
    "lines": fx.LINES,
    "off": "SELECT * FROM (VALUES (0, -1, 0, 1.0E0, 4), (1, -1, 1, sqrt(2), 2), (2, 0, 1, 1.0E0, 1), (3, 1, 1, sqrt(2), 128), (4, 1, 0, 1.0E0, 64), (5, 1, -1, sqrt(2), 32), (6, 0, -1, 1.0E0, 16), (7, -1, -1, sqrt(2), 8)) t(k, dr, dc, dist, code)",
    "moved": "SELECT cell_id AS src, dem AS z0, k, dist, (row + dr) * 100 + col + dc AS dst FROM stack, off WHERE row + dr >= 0 AND col + dc BETWEEN 0 AND 99",
    "edges": "SELECT src, cell_id AS dst, k, dist, z0, dem AS z FROM moved JOIN stack ON dst = cell_id",
    "pmoved": "SELECT cell_id AS src, dem AS z0, k, dist, (row + dr) * 20 + col + dc AS dst FROM parts, off WHERE row + dr >= 0 AND col + dc BETWEEN 0 AND 19",
    "pedges": "SELECT src, cell_id AS dst, k, dist, z0, dem AS z FROM pmoved JOIN parts ON dst = cell_id",
    "best": "SELECT src, dst, k FROM edges WHERE z0 > z QUALIFY row_number() OVER (PARTITION BY src ORDER BY (z0 - z) / dist DESC, k) = 1",
    "succ": "SELECT cell_id, dst AS next_id, k FROM stack LEFT JOIN best ON cell_id = src",
    "slopes": """SELECT cell_id, degrees(atan(sqrt(power(((ne + 2 * e + se) - (nw + 2 * w + sw)) / 8, 2) + power(((sw + 2 * s + se) - (nw + 2 * n + ne)) / 8, 2)))) AS slope FROM (
      SELECT cell_id, coalesce(max(CASE WHEN k = 0 THEN z END), dem) n, coalesce(max(CASE WHEN k = 1 THEN z END), dem) ne, coalesce(max(CASE WHEN k = 2 THEN z END), dem) e,
        coalesce(max(CASE WHEN k = 3 THEN z END), dem) se, coalesce(max(CASE WHEN k = 4 THEN z END), dem) s, coalesce(max(CASE WHEN k = 5 THEN z END), dem) sw,
        coalesce(max(CASE WHEN k = 6 THEN z END), dem) w, coalesce(max(CASE WHEN k = 7 THEN z END), dem) nw
      FROM stack LEFT JOIN edges ON cell_id = src GROUP BY cell_id, dem)""",
    "weights": "SELECT src, dst, power((z0 - z) / dist, 2) / sum(power((z0 - z) / dist, 2)) OVER (PARTITION BY src) AS w FROM edges WHERE z0 > z",
    "front": "SELECT cell_id, 0 AS step, 1.0E0 AS f FROM stack UNION ALL SELECT dst, max(step) + 1, sum(f * w) FROM front JOIN weights ON cell_id = src GROUP BY dst",
    "accs": "SELECT cell_id, sum(f) AS acc FROM front GROUP BY cell_id",
    "tterm": "SELECT cell_id, acc AS value, next_id, cell_id % 17 = 0 AS terminal FROM stack JOIN succ USING (cell_id)",
    "twalk": "SELECT cell_id AS src, next_id AS cur FROM tterm WHERE next_id IS NOT NULL UNION ALL SELECT src, next_id FROM twalk JOIN tterm ON cur = cell_id WHERE NOT terminal AND next_id IS NOT NULL",
    "traced": "SELECT cell_id, least(value, coalesce(m, value)) AS value FROM tterm LEFT JOIN (SELECT src, min(t.value) AS m FROM twalk JOIN tterm t ON cur = t.cell_id GROUP BY src) ON cell_id = src",
    "targets": "SELECT DISTINCT CAST(trunc((y - 0) / -1.0) AS BIGINT) * 100 + CAST(trunc(x) AS BIGINT) AS cell_id FROM points",
    "dwalk": """SELECT cell_id AS src, cell_id AS cur, 0.0E0 AS d FROM stack UNION ALL
      SELECT src, next_id, d + CASE WHEN k % 2 = 1 THEN sqrt(2) ELSE 1 END FROM dwalk JOIN succ ON cur = cell_id WHERE next_id IS NOT NULL AND cur NOT IN (SELECT cell_id FROM targets)""",
    "dist": "SELECT s.cell_id, min(CASE WHEN t.cell_id IS NOT NULL THEN d END) AS distance FROM stack s JOIN dwalk ON s.cell_id = src LEFT JOIN targets t ON cur = t.cell_id GROUP BY s.cell_id",
    "clean": "SELECT kind, layer_id, cell_id, CASE WHEN value >= 0 THEN value END AS value FROM layers",
    "lstats": "SELECT kind, layer_id, min(value) AS lo, max(value) AS hi, count(value) AS n, median(value) AS mid FROM clean GROUP BY kind, layer_id",
    "scored": """SELECT kind, layer_id, cell_id, CASE WHEN kind = 'rain' THEN (value - lo) / (hi - lo) WHEN value IS NULL THEN NULL
      ELSE greatest(0, least(1, CASE WHEN value <= mid THEN CASE WHEN mid - lo <= 0 THEN 1 ELSE (value - lo) / (mid - lo) END
        ELSE CASE WHEN hi - mid <= 0 THEN 1 ELSE (hi - value) / (hi - mid) END END)) END AS score FROM clean JOIN lstats USING (kind, layer_id)""",
    "pairs": "SELECT s.cell_id, conn * runoff * r.score * o.score AS p FROM stack s LEFT JOIN scored r ON r.kind = 'rain' AND r.cell_id = s.cell_id LEFT JOIN scored o ON o.kind = 'ofd' AND o.cell_id = s.cell_id",
    "ens": "SELECT cell_id, count(p) AS n, avg(p) AS mean, stddev_pop(p) AS stdev FROM pairs GROUP BY cell_id",
    "rscaled": "SELECT s.*, rain / m AS rain_s FROM stack s, (SELECT avg(rain) FILTER (WHERE valid) AS m FROM stack)",
    "er": "SELECT *, acc * tan(least(slope, 89) * pi() / 180) AS raw FROM rscaled",
    "seg": "SELECT a.line_id, a.seq, a.x AS x0, a.y AS y0, b.x - a.x AS vx, b.y - a.y AS vy FROM lines a JOIN lines b ON a.line_id = b.line_id AND b.seq = a.seq + 1",
    "near": """SELECT point_id, px, py, x0 + t * vx AS x, y0 + t * vy AS y, sqrt(power(px - (x0 + t * vx), 2) + power(py - (y0 + t * vy), 2)) AS d, line_id FROM (
      SELECT point_id, p.x AS px, p.y AS py, seg.*, greatest(0, least(1, ((p.x - x0) * vx + (p.y - y0) * vy) / (vx * vx + vy * vy))) AS t FROM points p, seg)
      QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, line_id) = 1""",
}
WET = "ln(abs(acc) * greatest({rain}, 1e-6) + 1) - ln(tan(greatest(0, least(89, slope)) * pi() / 180 + 0.001) + 0.001)"
NORM = "greatest(0, least(1, ({v} - lo) / CASE WHEN hi <= lo THEN 1 ELSE hi - lo END))"
BOUNDS = "(SELECT quantile_cont({v}, 0.05) AS lo, quantile_cont({v}, 0.95) AS hi FROM {t})"


def query(name: str, steps: str | None = None, sql: str | None = None):
    """Registers a query; steps: the named SQL steps that its SQL reads."""

    def put(fn):
        _QUERIES[name] = fn
        if sql:
            used = (steps or "").split()
            _SQL[name] = ("WITH RECURSIVE " + ", ".join(f"{s} AS {'MATERIALIZED ' * (s in ('edges', 'pedges', 'succ', 'best', 'weights', 'stack', 'tterm', 'targets'))}({STEPS[s]})" for s in used) + " " if used else "") + sql
        return fn

    return put


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _cells(s, d) -> DataFrame:
    return fx.stack(s, d)


query("grid_scan", "stack", "SELECT cell_id, row, col, dem FROM stack")(lambda s, d: _cells(s, d).select("cell_id", "row", "col", "dem"))
query("nodata_decode_exact", "parts", "SELECT cell_id, CASE WHEN dem <> 25 THEN dem END AS value FROM parts")(lambda s, d: fx.parts(s, d).select("cell_id", expr.decode_exact(F.col("dem"), 25.0).alias("value")))
query("nodata_decode_isclose", "parts", "SELECT cell_id, CASE WHEN abs(price - 1000) > 1e-8 + 1e-2 THEN price END AS value FROM parts")(lambda s, d: fx.parts(s, d).select("cell_id", expr.decode_isclose(F.col("price"), 1000.0).alias("value")))
query("flood_clean", "stack", "SELECT cell_id, CASE WHEN bal >= 0 THEN bal END AS value FROM stack")(lambda s, d: _cells(s, d).select("cell_id", expr.decode_flood(F.col("bal"), -9999.0).alias("value")))
query("valid_mask_stats", "stack", "SELECT count(*) AS n_cells, count(*) FILTER (WHERE valid) AS n_valid FROM stack")(lambda s, d: _cells(s, d).agg(F.count("*").alias("n_cells"), F.count_if("valid").alias("n_valid")))
query("coverage_ratio", "stack", "SELECT n_mask, n_finite, round(CAST(n_finite AS DOUBLE) / n_mask, 6) AS ratio FROM (SELECT count(*) FILTER (WHERE valid) AS n_mask, count(*) FILTER (WHERE valid AND bal >= 0) AS n_finite FROM stack)")(
    lambda s, d: rounded(stats.coverage(_cells(s, d).withColumn("v", expr.decode_flood(F.col("bal"), None)), "v", F.col("valid")), "ratio"))
query("masked_mean_rain_scale", "stack rscaled", "SELECT cell_id, round(rain_s, 6) AS rain_s FROM rscaled")(lambda s, d: rounded(stats.rain_scale(_cells(s, d), "rain", "rain_s", F.col("valid")).select("cell_id", "rain_s"), "rain_s"))


def _erosion(power: bool, weighted: bool):
    def run(s, d):
        e = expr.erosion(F.col("acc"), F.col("slope"), 1.0, power)
        return _cells(s, d).select("cell_id", F.round(e * F.col("lc") if weighted else e, 6).alias("erosion"))

    return run


_TAN = "acc * tan(least(slope, 89) * pi() / 180)"
query("erosion_stream_power", "stack", f"SELECT cell_id, round({_TAN}, 6) AS erosion FROM stack")(_erosion(True, False))
query("erosion_area_only", "stack", "SELECT cell_id, round(acc, 6) AS erosion FROM stack")(_erosion(False, False))
query("erosion_weighted", "stack", f"SELECT cell_id, round({_TAN} * lc, 6) AS erosion FROM stack")(_erosion(True, True))
query("wetness_index", "stack rscaled", f"SELECT cell_id, round({WET.format(rain='rain_s')}, 6) AS wetness FROM rscaled")(
    lambda s, d: stats.rain_scale(_cells(s, d), "rain", "rain_s", F.col("valid")).select("cell_id", F.round(expr.wetness(F.col("acc"), F.col("slope"), F.col("rain_s")), 6).alias("wetness")))
query("wetness_index_unit_rain", "stack", f"SELECT cell_id, round({WET.format(rain='1.0')}, 6) AS wetness FROM stack")(lambda s, d: _cells(s, d).select("cell_id", F.round(expr.wetness(F.col("acc"), F.col("slope"), F.lit(1.0)), 6).alias("wetness")))
query("percentile_normalise", "stack", f"SELECT cell_id, round({NORM.format(v='rain')}, 6) AS v FROM stack, {BOUNDS.format(v='rain', t='stack')}")(lambda s, d: rounded(stats.percentile_normalise(_cells(s, d), "rain", "v").select("cell_id", "v"), "v"))
query("percentile_normalise_constant", "stack", "SELECT cell_id, 0.0E0 AS v FROM stack")(lambda s, d: stats.percentile_normalise(_cells(s, d).withColumn("one", F.lit(7.0)), "one", "v").select("cell_id", "v"))
query("layer_min_max", "layers", "SELECT kind, layer_id, round(min(value), 6) AS lo, round(max(value), 6) AS hi, count(value) AS n FROM layers GROUP BY ALL")(lambda s, d: rounded(stats.layer_stats(fx.layers(s, d), False), "lo", "hi"))
query("layer_median", "layers", "SELECT kind, layer_id, round(median(value), 6) AS mid FROM layers GROUP BY ALL")(lambda s, d: rounded(stats.layer_stats(fx.layers(s, d)).select("kind", "layer_id", "mid"), "mid"))


def _scored(s, d) -> DataFrame:
    ls = fx.layers(s, d)
    return stats.normalised_layers(ls, stats.layer_stats(ls))


query("rainfall_normalise", "layers clean lstats scored", "SELECT layer_id, cell_id, round(score, 6) AS score FROM scored WHERE kind = 'rain'")(lambda s, d: rounded(_scored(s, d).where("kind = 'rain'").select("layer_id", "cell_id", "score"), "score"))
query("distance_stretch", "layers clean lstats scored", "SELECT layer_id, cell_id, round(score, 6) AS score FROM scored WHERE kind = 'ofd'")(lambda s, d: rounded(_scored(s, d).where("kind = 'ofd'").select("layer_id", "cell_id", "score"), "score"))


def _base(s, d) -> DataFrame:
    return _cells(s, d).select("cell_id", (F.col("conn") * F.col("runoff")).alias("base"))


_ENS = "stack layers clean lstats scored pairs ens"
query("flood_base", "stack", "SELECT cell_id, round(conn * runoff, 6) AS base FROM stack")(lambda s, d: rounded(_base(s, d), "base"))
query("flood_mean_raw", _ENS, "SELECT cell_id, round(mean, 6) AS mean FROM ens")(lambda s, d: rounded(stats.ensemble(_base(s, d), _scored(s, d)).select("cell_id", "mean"), "mean"))
query("flood_stdev", _ENS, "SELECT cell_id, round(stdev, 5) AS stdev FROM ens")(lambda s, d: stats.ensemble(_base(s, d), _scored(s, d)).select("cell_id", F.round("stdev", 5).alias("stdev")))
query("flood_mean_normalised", _ENS, "SELECT cell_id, round(mean / (SELECT max(mean) FROM ens), 6) AS mean FROM ens")(lambda s, d: rounded(stats.divide_by_max(stats.ensemble(_base(s, d), _scored(s, d)), "mean", "mean").select("cell_id", "mean"), "mean"))
query("flood_naive_pairs", _ENS, "SELECT cell_id, n, round(mean, 6) AS mean, round(stdev, 6) AS stdev FROM ens")(lambda s, d: rounded(stats.ensemble_pairs(_base(s, d), _scored(s, d)), "mean", "stdev"))
query("flood_risk", _ENS, "SELECT cell_id, n, round(mean / (SELECT max(mean) FROM ens), 6) AS mean, round(stdev, 5) AS stdev FROM ens")(
    lambda s, d: pipelines.flood_risk(_cells(s, d), fx.layers(s, d)).select("cell_id", "n", F.round("mean", 6).alias("mean"), F.round("stdev", 5).alias("stdev")))

_EDGES = "stack off moved edges"
_SUCC = f"{_EDGES} best succ"
query("neighbour_edges", _EDGES, "SELECT src, dst, k, round(dist, 6) AS dist FROM edges")(lambda s, d: rounded(neighbour.edges(_cells(s, d), 100).select("src", "dst", "k", "dist"), "dist"))
query("steepest_descent", _SUCC, "SELECT cell_id, next_id FROM succ")(lambda s, d: neighbour.steepest(_cells(s, d), 100).select("cell_id", "next_id"))
query("steepest_descent_ties", "parts off pmoved pedges", "SELECT cell_id, dst AS next_id FROM parts LEFT JOIN (SELECT src, dst FROM pedges WHERE z0 > z QUALIFY row_number() OVER (PARTITION BY src ORDER BY (z0 - z) / dist DESC, k) = 1) ON cell_id = src")(
    lambda s, d: neighbour.steepest(fx.parts(s, d), 20).select("cell_id", "next_id"))
query("d8_pointer_code", _SUCC, "SELECT cell_id, coalesce(code, 0) AS code FROM succ LEFT JOIN off USING (k)")(lambda s, d: neighbour.d8_code(neighbour.steepest(_cells(s, d), 100)))
query("d8_decode", "stack off", "SELECT s.cell_id, t.cell_id AS next_id FROM (SELECT *, CAST([1, 2, 4, 8, 16, 32, 64, 128, 0, 3][1 + cell_id % 10] AS INT) AS code FROM stack) s LEFT JOIN off USING (code) LEFT JOIN stack t ON s.col + dc BETWEEN 0 AND 99 AND s.row + dr >= 0 AND t.cell_id = (s.row + dr) * 100 + s.col + dc")(
    lambda s, d: neighbour.d8_decode(_cells(s, d).withColumn("code", F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 16, 32, 64, 128, 0, 3))), (1 + F.col("cell_id") % 10).cast("int"))), 100))
query("slope_horn", f"{_EDGES} slopes", "SELECT cell_id, round(slope, 6) AS slope FROM slopes")(lambda s, d: rounded(neighbour.slope(_cells(s, d), 100), "slope"))


def _traceable(s, d) -> DataFrame:
    c = _cells(s, d)
    return c.select("cell_id", F.col("acc").alias("value"), (F.col("cell_id") % 17 == 0).alias("terminal")).join(neighbour.steepest(c, 100).select("cell_id", "next_id"), "cell_id")


_TRACE = f"{_SUCC} tterm twalk traced"
query("trace_init", f"{_SUCC} tterm", "SELECT a.cell_id, CASE WHEN b.terminal THEN least(a.value, b.value) ELSE a.value END AS value, CASE WHEN NOT b.terminal THEN a.next_id END AS next_id, b.cell_id IS NULL OR b.terminal AS done FROM tterm a LEFT JOIN tterm b ON a.next_id = b.cell_id")(
    lambda s, d: flow.trace_start(_traceable(s, d)))
query("trace_min", _TRACE, "SELECT * FROM traced")(lambda s, d: flow.trace_min(_traceable(s, d)))
query("connectivity_norm", _TRACE, f"SELECT cell_id, round({NORM.format(v='value')}, 6) AS connectivity FROM traced, {BOUNDS.format(v='value', t='traced')}")(
    lambda s, d: rounded(flow.connectivity(_cells(s, d).withColumn("wetness", F.col("acc")).withColumn("channel", F.col("cell_id") % 17 == 0), 100).select("cell_id", "connectivity"), "connectivity"))


def _distance(s, d) -> DataFrame:
    c = _cells(s, d)
    return flow.distance(neighbour.steepest(c, 100), vector.points_to_cells(fx.points(s, d), fx.grid(s, d)), 100)


_DIST = f"points targets {_SUCC} dwalk dist"
query("flow_distance", _DIST, "SELECT cell_id, round(distance, 6) AS distance FROM dist")(lambda s, d: rounded(_distance(s, d), "distance"))
query("flow_distance_unreached", _DIST, "SELECT count(*) AS n, count(distance) AS reached FROM dist")(lambda s, d: _distance(s, d).agg(F.count("*").alias("n"), F.count("distance").alias("reached")))
query("overland_flow_distance", _DIST, "SELECT cell_id, round(distance, 6) AS distance FROM dist")(lambda s, d: rounded(pipelines.overland_flow_distance(_cells(s, d), fx.grid(s, d), fx.points(s, d), condition=False), "distance"))
STEPS["targets2"] = "SELECT DISTINCT greatest(0, CAST(trunc((CASE WHEN d > 2 THEN py ELSE y END - 0) / -1.0) AS BIGINT)) * 100 + least(99, CAST(trunc(CASE WHEN d > 2 THEN px ELSE x END) AS BIGINT)) AS cell_id FROM near"
STEPS["dwalk2"], STEPS["dist2"] = STEPS["dwalk"].replace("dwalk", "dwalk2").replace("targets", "targets2"), STEPS["dist"].replace("dwalk", "dwalk2").replace("targets", "targets2")
query("overland_flow_distance_snapped", f"points lines seg near targets2 {_SUCC} dwalk2 dist2", "SELECT cell_id, round(distance, 6) AS distance FROM dist2")(
    lambda s, d: rounded(pipelines.overland_flow_distance(_cells(s, d), fx.grid(s, d), fx.points(s, d), fx.lines(s, d), 2.0, condition=False), "distance"))
query("overland_flow_distance_breached")(lambda s, d: rounded(pipelines.overland_flow_distance(_cells(s, d), fx.grid(s, d), fx.points(s, d)), "distance"))

_FD8 = f"{_EDGES} weights"
query("fd8_weights", _FD8, "SELECT src, dst, round(w, 6) AS w FROM weights")(lambda s, d: rounded(neighbour.flow_weights(_cells(s, d), 100), "w"))
query("fd8_accumulation", f"{_FD8} front accs", "SELECT cell_id, round(acc, 6) AS acc FROM accs")(lambda s, d: rounded(flow.accumulation(_cells(s, d), 100), "acc"))
query("extract_streams", "stack", "SELECT cell_id FROM stack WHERE acc > 250")(lambda s, d: _cells(s, d).where("acc > 250").select("cell_id"))
query("channel_mask", "stack", "SELECT cell_id, acc > 250 AND valid AS channel FROM stack")(lambda s, d: _cells(s, d).select("cell_id", ((F.col("acc") > 250) & F.col("valid")).alias("channel")))
query("catchment_area", "stack", "SELECT cell_id, acc * 25 AS area FROM stack")(lambda s, d: _cells(s, d).select("cell_id", expr.catchment_area(F.col("acc"), 25.0).alias("area")))
query("rain_weighted_area", "stack rscaled", "SELECT cell_id, round(acc * rain_s, 6) AS area FROM rscaled")(lambda s, d: stats.rain_scale(_cells(s, d), "rain", "rain_s", F.col("valid")).select("cell_id", F.round(expr.catchment_area(F.col("acc"), 1.0) * F.col("rain_s"), 6).alias("area")))
query("in_channel_risk", "stack rscaled", "SELECT cell_id, round(CASE WHEN acc >= 100 THEN lc * conn * acc / (acc * rain_s + 1e-10) END, 6) AS risk FROM rscaled")(
    lambda s, d: stats.rain_scale(_cells(s, d), "rain", "rain_s", F.col("valid")).select("cell_id", F.round(expr.in_channel_risk(F.col("lc") * F.col("conn"), F.col("acc"), F.col("rain_s"), 1.0, 100.0), 6).alias("risk")))
query("collapse_guard", "stack", "SELECT cell_id, CASE WHEN acc >= 100 THEN lc END AS risk FROM stack")(
    lambda s, d: stats.collapse_guard(_cells(s, d).withColumn("r", F.when(F.col("acc") >= 100, F.col("conn"))), "r", "conn", "lc", F.col("acc") >= 100, "risk").select("cell_id", "risk"))
query("points_to_cells", "points targets", "SELECT cell_id FROM targets")(lambda s, d: vector.points_to_cells(fx.points(s, d), fx.grid(s, d)).select("cell_id"))
query("points_clamped", "points", "SELECT DISTINCT greatest(0, least(9, CAST(trunc(-y) AS BIGINT))) * 10 + greatest(0, least(9, CAST(trunc(x - 50) AS BIGINT))) AS cell_id FROM points")(lambda s, d: vector.points_to_cells(fx.points(s, d).withColumn("x", F.col("x") - 50), g.Grid(10, 10)).select("cell_id"))
query("points_multipart", None, "SELECT CAST(n_nationkey AS BIGINT) AS point_id, CAST(v AS DOUBLE) AS x, CAST(-v AS DOUBLE) AS y FROM nation, (VALUES (0), (1)) t(v)")(
    lambda s, d: vector.explode_points(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("feature_id"), F.array(*[F.struct(F.lit(float(v)).alias("x"), F.lit(float(-v)).alias("y")) for v in (0, 1)]).alias("parts"))).withColumn("y", F.col("y") + 0.0))
query("snap_points", "points lines seg near", "SELECT point_id, round(CASE WHEN d > 2 THEN px ELSE x END, 6) AS x, round(CASE WHEN d > 2 THEN py ELSE y END, 6) AS y, d <= 2 AS snapped FROM near")(lambda s, d: rounded(vector.snap(fx.points(s, d), fx.lines(s, d), 2.0), "x", "y"))
query("line_sample_risk", "stack lines", "SELECT line_id, round(avg(lc), 6) AS risk FROM lines LEFT JOIN stack ON x < 100 AND cell_id = CAST(trunc(-y) AS BIGINT) * 100 + CAST(trunc(x) AS BIGINT) GROUP BY line_id")(lambda s, d: rounded(vector.line_mean(fx.lines(s, d), _cells(s, d), "lc", fx.grid(s, d)), "risk"))
STEPS |= {
    "st": "SELECT cell_id, next_id FROM succ JOIN stack USING (cell_id) WHERE acc > 100",
    "stn": "SELECT a.cell_id, b.cell_id AS next_id FROM st a LEFT JOIN st b ON a.next_id = b.cell_id",
    "indeg": "SELECT next_id AS cell_id, count(*) AS n FROM stn WHERE next_id IS NOT NULL GROUP BY next_id",
    "heads": "SELECT s.cell_id FROM stn s LEFT JOIN indeg USING (cell_id) WHERE coalesce(n, 0) <> 1",
    "lwalk": "SELECT cell_id AS line_id, CAST(0 AS BIGINT) AS seq, cell_id, false AS stop FROM heads UNION ALL SELECT line_id, seq + 1, s.next_id, s.next_id IN (SELECT cell_id FROM heads) FROM lwalk w JOIN stn s ON w.cell_id = s.cell_id WHERE NOT stop AND s.next_id IS NOT NULL",
}
query("stream_links", f"{_SUCC} st stn indeg heads lwalk", "SELECT line_id, seq, cell_id FROM lwalk")(lambda s, d: flow.stream_links(_cells(s, d).where("acc > 100"), neighbour.steepest(_cells(s, d), 100)))
query("encode_nodata_masked", "stack", "SELECT cell_id, CASE WHEN valid THEN CASE WHEN bal >= 0 THEN bal END ELSE -9999 END AS value FROM stack")(lambda s, d: _cells(s, d).select("cell_id", g.encode_masked(expr.decode_flood(F.col("bal"), None), F.col("valid")).alias("value")))
query("encode_nodata_unmasked", "stack", "SELECT cell_id, coalesce(CASE WHEN bal >= 0 THEN bal END, -9999) AS value FROM stack")(lambda s, d: _cells(s, d).select("cell_id", g.encode_unmasked(expr.decode_flood(F.col("bal"), None)).alias("value")))
query("tiles", "stack", "SELECT cell_id, row // 32 AS tile_row, col // 32 AS tile_col FROM stack")(lambda s, d: g.tile(_cells(s, d), 32).select("cell_id", "tile_row", "tile_col"))
query("cell_threshold", None, "SELECT n_nationkey, CAST(greatest(1, 800000 / ((n_nationkey + 1) * (n_nationkey + 1))) AS DOUBLE) AS cells FROM nation")(
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.greatest(F.lit(1.0), F.lit(800000.0) / F.pow(F.col("n_nationkey") + 1, F.lit(2.0))).alias("cells")))
query("translate_message", None, "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Keine gueltigen Zellen' WHEN 1 THEN 'Sin celdas validas' ELSE 'No valid cells' END AS said FROM nation")(
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", expr.translate(F.lit("No valid cells"), F.element_at(F.array(F.lit("de_DE"), F.lit("es-MX"), F.lit("fr")), (F.col("n_nationkey") % 3 + 1).cast("int")), WORDS).alias("said")))


@query("grid_alignment", None, "SELECT CAST(v AS INT) AS shift, v = 0 AS aligned FROM (VALUES (0), (1)) t(v)")
def _alignment(s, d):
    def fits(shift: int) -> bool:
        try:
            g.check_aligned(g.Grid(10, 10), g.Grid(10, 10, (float(shift), *GT[1:])), "other")
        except ValueError:
            return False
        return True

    return s.createDataFrame([(k, fits(k)) for k in (0, 1)], "shift int, aligned boolean")


query("depression_breaching")(lambda s, d: condition.breach(fx.parts(s, d).withColumn("raster_id", F.lit("part")), 20))

STEPS |= {
    "w2": f"SELECT cell_id, next_id, acc, slope, acc > 20 AS terminal, {WET.format(rain='1.0')} AS value FROM succ JOIN accs USING (cell_id) JOIN slopes USING (cell_id)",
    "walk2": "SELECT cell_id AS src, next_id AS cur FROM w2 WHERE next_id IS NOT NULL UNION ALL SELECT src, next_id FROM walk2 JOIN w2 ON cur = cell_id WHERE NOT terminal AND next_id IS NOT NULL",
    "tr2": "SELECT cell_id, acc, slope, terminal, least(value, coalesce(m, value)) AS value FROM w2 LEFT JOIN (SELECT src, min(t.value) AS m FROM walk2 JOIN w2 t ON cur = t.cell_id GROUP BY src) ON cell_id = src",
    "rsc": "SELECT s.*, rain / m AS rain_s FROM stack s, (SELECT avg(rain) AS m FROM stack)",
    "w1": f"SELECT r.cell_id, next_id, a.acc, p.slope, rain_s, a.acc * tan(least(p.slope, 89) * pi() / 180) * lc AS raw, a.acc > 20 AS terminal, ln(a.acc * greatest(rain_s, 1e-6) + 1) - ln(tan(least(89, p.slope) * pi() / 180 + 0.001) + 0.001) AS value FROM rsc r JOIN succ USING (cell_id) JOIN accs a USING (cell_id) JOIN slopes p USING (cell_id)",
    "walk1": "SELECT cell_id AS src, next_id AS cur FROM w1 WHERE next_id IS NOT NULL UNION ALL SELECT src, next_id FROM walk1 JOIN w1 ON cur = cell_id WHERE NOT terminal AND next_id IS NOT NULL",
    "tr1": "SELECT w1.*, least(value, coalesce(m, value)) AS f FROM w1 LEFT JOIN (SELECT src, min(t.value) AS m FROM walk1 JOIN w1 t ON cur = t.cell_id GROUP BY src) ON cell_id = src",
    "out1": f"SELECT *, {NORM.format(v='f').replace('lo', 'clo').replace('hi', 'chi')} AS connectivity, {NORM.format(v='raw').replace('lo', 'elo').replace('hi', 'ehi')} AS erosion FROM tr1, (SELECT quantile_cont(f, 0.05) AS clo, quantile_cont(f, 0.95) AS chi, quantile_cont(raw, 0.05) AS elo, quantile_cont(raw, 0.95) AS ehi FROM tr1)",
}
query("network_index", f"{_SUCC} slopes weights front accs w2 walk2 tr2", f"SELECT cell_id, round(acc, 5) AS acc, terminal AS channel, round({NORM.format(v='value')}, 5) AS connectivity FROM tr2, {BOUNDS.format(v='value', t='tr2')}")(
    lambda s, d: pipelines.network_index(_cells(s, d).select("cell_id", "row", "col", "dem"), fx.grid(s, d), 20.0, condition=False).select("cell_id", F.round("acc", 5).alias("acc"), "channel", F.round("connectivity", 5).alias("connectivity")))
query("sediment_risk", f"{_SUCC} slopes weights front accs rsc w1 walk1 tr1 out1", "SELECT cell_id, round(connectivity, 5) AS connectivity, round(erosion, 5) AS erosion, round(CASE WHEN acc >= 10 THEN connectivity * erosion * acc / (acc * rain_s + 1e-10) END, 5) AS risk FROM out1")(
    lambda s, d: pipelines.sediment_risk(_cells(s, d).select("cell_id", "row", "col", "dem", "lc", "rain"), fx.grid(s, d), 10.0, network_cells=20.0, condition=False).select("cell_id", *[F.round(c, 5).alias(c) for c in ("connectivity", "erosion", "risk")]))

query("network_index_breached")(
    lambda s, d: pipelines.network_index(_cells(s, d).select("cell_id", "row", "col", "dem"), fx.grid(s, d), 20.0).select("cell_id", F.round("acc", 5).alias("acc"), "channel", F.round("connectivity", 5).alias("connectivity")))
STEPS |= {
    "risk1": "SELECT cell_id, next_id, terminal, CASE WHEN acc >= 10 THEN connectivity * erosion * acc / (acc * rain_s + 1e-10) END AS risk FROM out1",
    "st1": "SELECT a.cell_id, b.cell_id AS next_id FROM risk1 a LEFT JOIN risk1 b ON a.next_id = b.cell_id AND b.terminal WHERE a.terminal",
    "heads1": "SELECT cell_id FROM st1 LEFT JOIN (SELECT next_id AS c, count(*) AS n FROM st1 WHERE next_id IS NOT NULL GROUP BY next_id) ON c = cell_id WHERE coalesce(n, 0) <> 1",
    "lwalk1": "SELECT cell_id AS line_id, CAST(0 AS BIGINT) AS seq, cell_id, false AS stop FROM heads1 UNION ALL SELECT line_id, seq + 1, s.next_id, s.next_id IN (SELECT cell_id FROM heads1) FROM lwalk1 w JOIN st1 s ON w.cell_id = s.cell_id WHERE NOT stop AND s.next_id IS NOT NULL",
}


@query("sediment_lines", f"{_SUCC} slopes weights front accs rsc w1 walk1 tr1 out1 risk1 st1 heads1 lwalk1", "SELECT line_id, seq, cell_id, cell_id % 100 + 0.5E0 AS x, -(cell_id // 100 + 0.5E0) AS y, round(avg(risk) OVER (PARTITION BY line_id), 5) AS risk FROM lwalk1 JOIN risk1 USING (cell_id)")
def _sediment_lines(s, d):
    cells, grid = _cells(s, d).select("cell_id", "row", "col", "dem", "lc", "rain"), fx.grid(s, d)
    risk = pipelines.sediment_risk(cells, grid, 10.0, network_cells=20.0, condition=False)
    out = pipelines.sediment_lines(cells, risk, grid)
    return out.select("line_id", "seq", "cell_id", "x", "y", F.round("risk", 5).alias("risk"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
