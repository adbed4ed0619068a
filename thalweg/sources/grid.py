"""Grids: metadata, alignment, readers and writers of cells."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


@dataclass(frozen=True)
class Grid:
    """cols, rows and the six affine terms; cells are addressed by row * cols + col."""

    cols: int
    rows: int
    gt: tuple = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    crs: str = ""
    nodata: float | None = None

    def __post_init__(self):
        if self.cols < 1 or self.rows < 1 or len(self.gt) != 6 or not self.gt[1] or not self.gt[5]:
            raise ValueError("a grid needs a size and six affine terms with cells of some size")


def check_crs(reference: Grid, crs: str, name: str) -> None:
    """Raises where both reference systems are named and differ; nothing is transformed."""
    if reference.crs and crs and reference.crs != crs:
        raise ValueError(f"{name}: its reference system {crs} is not {reference.crs}")


def check_aligned(reference: Grid, other: Grid, name: str) -> None:
    """Same size, each affine term within 1e-9, and the same reference system where both name one."""
    check_crs(reference, other.crs, name)
    if (reference.cols, reference.rows) != (other.cols, other.rows):
        raise ValueError(f"{name}: its size {other.cols} x {other.rows} is not {reference.cols} x {reference.rows}")
    if any(abs(a - b) > 1e-9 for a, b in zip(reference.gt, other.gt)):
        raise ValueError(f"{name}: its geotransform differs from the reference grid's")


def check_outputs(**paths: str) -> None:
    given = [p for p in paths.values() if p]
    if len(set(given)) != len(given):
        raise ValueError(f"outputs must be distinct files: {', '.join(sorted(paths))}")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[Grid, DataFrame]:
    """An Esri ASCII grid: its header and (cell_id, row, col, value), one task a block of lines.

    Lines are numbered by their place in the file, so only line lengths' order matters, not their task.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("at"))
    head = {}
    for r in lines.orderBy("at").limit(6).collect():
        name, _, value = r.value.strip().partition(" ")
        if name[:1].isalpha():
            head[name.lower()] = float(value)
    size = head["cellsize"]
    y = head.get("yllcorner", head.get("yllcenter", 0.0)) + head["nrows"] * size
    grid = Grid(int(head["ncols"]), int(head["nrows"]), (head.get("xllcorner", head.get("xllcenter", 0.0)), size, 0.0, y, 0.0, -size), nodata=head.get("nodata_value"))
    body = lines.where(~F.col("value").rlike("^\\s*[A-Za-z]")).rdd.map(lambda r: (r.at, r.value)).sortByKey().zipWithIndex()
    rows = spark.createDataFrame(body.map(lambda x: (x[1], x[0][1])), "row long, value string")
    cells = rows.select("row", F.posexplode(F.split(F.trim("value"), "\\s+")).alias("col", "v"))
    return grid, cells.select((F.col("row") * grid.cols + F.col("col")).alias("cell_id"), "row", F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("value"))


def stack_layers(layers: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """(kind, layer_id, cell_id, value) of several layers; none is an error."""
    if not layers:
        raise ValueError("no layers are given")
    out = None
    for kind, number, df in layers:
        one = df.select(F.lit(kind).alias("kind"), F.lit(number).alias("layer_id"), "cell_id", "value")
        out = one if out is None else out.unionByName(one)
    return out


def tile(df: DataFrame, size: int = 1024) -> DataFrame:
    """Adds tile_row and tile_col of square tiles."""
    return df.withColumn("tile_row", F.floor(F.col("row") / size)).withColumn("tile_col", F.floor(F.col("col") / size))


def encode_masked(v: Column, mask: Column) -> Column:
    """-9999 outside the mask; missing within it stays missing (NaN in a raster)."""
    return F.when(mask, v).otherwise(F.lit(-9999.0))


def encode_unmasked(v: Column) -> Column:
    return F.coalesce(v, F.lit(-9999.0))


def write_raster(cells: DataFrame, path: str, column: str, mask: str | None = None) -> None:
    """Cells with nodata written as -9999 and values as float."""
    v = encode_masked(F.col(column), F.col(mask)) if mask else encode_unmasked(F.col(column))
    cells.select("cell_id", "row", "col", v.cast("float").alias(column)).write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """(line_id, risk, vertices, wkt): one row a line, its vertices in order."""
    v = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    out = lines.groupBy("line_id").agg(F.first("risk").alias("risk"), v.alias("vertices"))
    text = F.array_join(F.transform("vertices", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    out.withColumn("wkt", F.concat(F.lit("LINESTRING ("), text, F.lit(")"))).write.mode("overwrite").parquet(path)


def _shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. A local folder is made only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_thalweg_cells", None) or f"file://{tempfile.mkdtemp(prefix='thalweg-cells-')}"
        spark._thalweg_cells = base
    path = f"{base.rstrip('/')}/thalweg-cells-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _release() -> None:
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended and nothing can be deleted through it
            return


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: plans of rounds stay short, lost executors lose
    nothing, and joins see the table's size on disk.
    """
    path = _shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
