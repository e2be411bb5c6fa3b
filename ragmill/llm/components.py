"""Connected components over DataFrames, without gathering edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b): the smallest node it is joined with.

    Each round takes the smallest label among neighbours, then the label's own label, so long chains halve.
    Joins read written tables, so that skewed ones can be split; minima are combined before the shuffle.
    """
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            discard(both)
            return labels
        total = now
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))
        near = materialize(near.union(labels).groupBy("node").agg(F.min("component").alias("component")), "near")
        up = near.select(F.col("node").alias("component"), F.col("component").alias("up"))
        old = labels
        labels = materialize(near.join(up, "component").select("node", F.col("up").alias("component")), "labels")
        discard(old, near)
