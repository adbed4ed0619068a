"""Grids derived from the test tables, as DataFrames and as SQL, so that queries and their SQL see the same data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.grid import Grid

GRID_COLS = 100

_LC = "CASE o_orderpriority WHEN '1-URGENT' THEN 1.0E0 WHEN '2-HIGH' THEN 0.8E0 WHEN '3-MEDIUM' THEN 0.5E0 WHEN '4-NOT SPECIFIED' THEN 0.2E0 WHEN '5-LOW' THEN 0.05E0 END"

#: The same text in both dialects, but for integer division, which {div} stands for.
STACK = f"""
SELECT CAST(o_orderkey AS BIGINT) AS cell_id, CAST(o_orderkey {{div}} 100 AS BIGINT) AS row, CAST(o_orderkey % 100 AS BIGINT) AS col,
  CAST(o_totalprice AS DOUBLE) AS dem, {_LC} AS lc, 500 + coalesce(c_acctbal, 0) / 10 AS rain, o_orderstatus <> 'P' AS valid,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS conn, {_LC} AS runoff,
  CAST(1 + o_orderkey % 500 AS DOUBLE) AS acc, CAST((o_orderkey * 7) % 95 AS DOUBLE) AS slope, c_acctbal AS bal
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""
LAYERS = """
SELECT 'rain' AS kind, CAST(l_linenumber AS INT) AS layer_id, l_orderkey AS cell_id, avg(l_extendedprice) AS value FROM lineitem GROUP BY l_linenumber, l_orderkey
UNION ALL
SELECT 'ofd' AS kind, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS layer_id, l_orderkey AS cell_id, avg(l_quantity) AS value
FROM lineitem GROUP BY l_returnflag, l_orderkey
"""
PARTS = "SELECT p_partkey AS cell_id, CAST(p_partkey {div} 20 AS BIGINT) AS row, CAST(p_partkey % 20 AS BIGINT) AS col, CAST(p_size AS DOUBLE) AS dem, p_retailprice AS price FROM part"
POINTS = "SELECT s_suppkey AS point_id, CAST((s_suppkey * 7) % 100 AS DOUBLE) + 0.5E0 AS x, -(CAST(s_suppkey % 15 AS DOUBLE) + 0.5E0) AS y FROM supplier"
LINES = """
SELECT CAST(n_nationkey AS BIGINT) AS line_id, 0 AS seq, CAST(4 * n_nationkey AS DOUBLE) AS x, 0.0E0 AS y FROM nation
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 1, CAST(4 * n_nationkey + 3 AS DOUBLE), -14.0E0 FROM nation
"""


def _sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    for t in tables:
        text = text.replace(f" {t} ", f" parquet.`{d}/{t}.parquet` ").replace(f"FROM {t}\n", f"FROM parquet.`{d}/{t}.parquet`\n")
        if text.endswith(f"FROM {t}"):
            text = text[: -len(t)] + f"parquet.`{d}/{t}.parquet`"
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # grouping above a union of like-partitioned inputs loses rows in 4.1.2
    return spark.sql(text.format(div="div"))


def stack(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, STACK, "orders", "customer")


def layers(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, LAYERS, "lineitem")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, PARTS, "part")


def points(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, POINTS, "supplier")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, LINES, "nation")


def grid(spark: SparkSession, d: str) -> Grid:
    """The grid that the orders fill: 100 columns of cells of 1 by 1."""
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    return Grid(GRID_COLS, max(1, -(-n // GRID_COLS)))
