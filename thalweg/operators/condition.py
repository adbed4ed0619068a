"""Depression breaching: a least-cost search that needs a global queue, one raster in one task."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.expr import OFFSETS


def breach_array(dem: np.ndarray) -> np.ndarray:
    """Floods inwards from the edge and from missing cells in rising order; a cell reached from below a
    pit has its path carved down to the pit's height, so that every cell can drain. Flats stay flat.
    """
    rows, cols = dem.shape
    out, back, seen, queue = dem.copy(), np.full(dem.size, -1, np.int64), np.isnan(dem), []
    for r in range(rows):
        for c in range(cols):
            if not seen[r, c] and (r in (0, rows - 1) or c in (0, cols - 1) or any(np.isnan(dem[r + dr, c + dc]) for dr, dc in OFFSETS)):
                heapq.heappush(queue, (dem[r, c], r * cols + c))
    for _, i in queue:
        seen.flat[i] = True
    while queue:
        _, i = heapq.heappop(queue)
        z, j = dem.flat[i], i
        while back[j] >= 0 and out.flat[back[j]] > z:
            j = back[j]
            out.flat[j] = z
        r, c = divmod(i, cols)
        for dr, dc in OFFSETS:
            a, b = r + dr, c + dc
            if 0 <= a < rows and 0 <= b < cols and not seen[a, b]:
                seen[a, b] = True
                back[a * cols + b] = i
                heapq.heappush(queue, (dem[a, b], a * cols + b))
    return out


def breach(cells: DataFrame, cols: int) -> DataFrame:
    """cells: (raster_id, cell_id, dem) to (raster_id, cell_id, dem) without pits; each raster fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = int(pdf.cell_id.max()) // cols + 1
        grid = np.full(rows * cols, np.nan)
        grid[pdf.cell_id] = pdf.dem.astype(float)
        done = breach_array(grid.reshape(rows, cols)).ravel()[pdf.cell_id]
        return pd.DataFrame({"raster_id": pdf.raster_id, "cell_id": pdf.cell_id, "dem": pd.Series(done, index=pdf.index).where(~np.isnan(done), None)})

    return cells.select("raster_id", "cell_id", "dem").groupBy("raster_id").applyInPandas(run, "raster_id string, cell_id long, dem double")
