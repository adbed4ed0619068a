"""Connected components of an undirected graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Each round, a node takes the smallest label among its own and its neighbours', then its label's
    label; rounds end when none changes. Every round is written to the shared folder, so plans stay
    short and lost executors cost nothing but their tasks. Loops and repeated edges do no harm; an empty
    edge table gives an empty result. A node of very many edges meets them in a join that Spark may
    split and in an aggregate that each task begins for itself.
    """
    spark, paths = edges.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    both = keep(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        jump = step.alias("s").join(labels.select(F.col("node").alias("j"), F.col("component").alias("jc")), F.col("s.c") == F.col("j"), "left")
        new = keep(jump.select("s.node", "s.was", F.least("s.c", F.coalesce("jc", "s.c")).alias("component")))
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            for p in paths[:-1]:
                release(spark, p)
            return labels
