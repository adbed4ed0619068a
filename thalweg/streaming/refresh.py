"""Layers that arrive over time: per-cell sums of the ensemble are mergeable, so each batch adds its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_sums(scored: DataFrame) -> DataFrame:
    """(kind, cell_id, n, s, q) of normalised layers: counts, sums and sums of squares."""
    return scored.groupBy("kind", "cell_id").agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q"))


def merge_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("kind", "cell_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def stream_sums(scored_stream: DataFrame) -> DataFrame:
    """The same over a streaming DataFrame, for writeStream in complete or update mode."""
    return layer_sums(scored_stream)
