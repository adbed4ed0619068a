"""Cell-wise map algebra as Column expressions. Missing is NULL; a non-finite result becomes NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: D8 codes by offset number, in the order N, NE, E, SE, S, SW, W, NW (fixed values).
D8_CODES = (4, 2, 1, 128, 64, 32, 16, 8)
#: (drow, dcol) of the same offsets.
OFFSETS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clip(v: Column, lo: float, hi: float) -> Column:
    """greatest and least skip NULL, so a missing value has to be kept out of them."""
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def decode_exact(v: Column, nodata: float | None) -> Column:
    v = finite(v.cast("double"))
    return v if nodata is None or math.isnan(nodata) else F.when(v != nodata, v)


def decode_isclose(v: Column, nodata: float | None) -> Column:
    """Within 1e-8 + 1e-5 * |nodata| of nodata is missing."""
    v = finite(v.cast("double"))
    if nodata is None or not math.isfinite(nodata):
        return v
    return F.when(F.abs(v - nodata) > 1e-8 + 1e-5 * abs(nodata), v)


def decode_flood(v: Column, nodata: float | None) -> Column:
    v = decode_isclose(v, nodata)
    return F.when(v >= 0, v)


def cell_area(gt: tuple) -> float:
    return abs(gt[1] * gt[5])


def threshold_cells(square_metres: float, gt: tuple) -> float:
    return max(1.0, square_metres / cell_area(gt))


def catchment_area(acc: Column, area: float) -> Column:
    return F.abs(acc) * area


def erosion(acc: Column, slope: Column, area: float, stream_power: bool = True) -> Column:
    out = catchment_area(acc, area)
    return finite(out * F.tan(clip(slope, 0.0, 89.0) * (math.pi / 180)) if stream_power else out)


def wetness(acc: Column, slope: Column, rain: Column) -> Column:
    """Only where everything is finite and both logarithms have positive arguments."""
    up = F.abs(acc) * F.when(rain.isNotNull(), F.greatest(rain, F.lit(1e-6))) + 1
    down = F.tan(clip(slope, 0.0, 89.0) * (math.pi / 180) + 0.001) + 0.001
    return finite(F.when((up > 0) & (down > 0), F.ln(up) - F.ln(down)))


def rain_normalise(v: Column, lo: Column, hi: Column) -> Column:
    return finite(F.try_divide(v - lo, hi - lo))


def peak_at_median(v: Column, lo: Column, mid: Column, hi: Column) -> Column:
    """1 at the median, falling to 0 at the least and the largest value."""
    left = F.when(mid - lo <= 0, F.lit(1.0)).otherwise(F.try_divide(v - lo, mid - lo))
    right = F.when(hi - mid <= 0, F.lit(1.0)).otherwise(F.try_divide(hi - v, hi - mid))
    return F.when(v.isNotNull(), clip(F.when(v <= mid, left).otherwise(right), 0.0, 1.0))


def in_channel_risk(source: Column, acc: Column, rain: Column, area: float, threshold: float) -> Column:
    a = catchment_area(acc, area)
    return finite(F.when(F.abs(acc) >= threshold, F.try_divide(source * a, a * rain + 1e-10)))


def clamp_distance(d: Column, valid: Column) -> Column:
    return F.when(valid & d.isNotNull(), F.greatest(d, F.lit(0.0)))


def map_to_cell(x: Column, y: Column, gt: tuple) -> tuple[Column, Column]:
    """(col, row), truncated towards zero."""
    return ((x - gt[0]) / gt[1]).cast("long"), ((y - gt[3]) / gt[5]).cast("long")


def map_to_cell_affine(x: Column, y: Column, gt: tuple) -> tuple[Column, Column]:
    """The same by all six terms."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = x - gt[0], y - gt[3]
    return ((dx * gt[5] - dy * gt[2]) / det).cast("long"), ((dy * gt[1] - dx * gt[4]) / det).cast("long")


def clamp(v: Column, n: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), v))


def translate(text: Column, language: Column, catalogue: dict[str, dict[str, str]]) -> Column:
    """The text in a language, else the text itself. en_GB and en-gb mean en."""
    short = F.split(F.lower(F.coalesce(language, F.lit("en"))), "[_-]")[0]
    pairs = [x for t, by in catalogue.items() for lang, said in by.items() for x in (F.lit(f"{lang}\x1f{t}"), F.lit(said))]
    if not pairs:
        return text
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\x1f", short, text)), text)
