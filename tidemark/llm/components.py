"""Connected components by distributed minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import frozen


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of
    its component.

    Each round a node takes the smallest label among its neighbours, then the
    label of its label (which doubles the distance a label travels), until no
    label falls. Both tables of every join are checkpoints, so Spark deals a
    hub's rows over several tasks; minima combine map-side. Only sums reach
    the driver. No edges give no rows.
    """
    links = frozen(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
                   .unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))))
    labels = frozen(links.groupBy(F.col("x").alias("node"))
                    .agg(F.least(F.min("y"), F.col("node")).alias("root")))
    before = None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total is None or total == before:
            return labels
        before = total
        told = (links.join(labels, links.x == labels.node)
                .select(F.col("y").alias("node"), "root"))
        labels = frozen(labels.unionByName(told).groupBy("node").agg(F.min("root").alias("root")))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = frozen(labels.join(above, "root").select("node", F.col("top").alias("root")))
