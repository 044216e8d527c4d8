"""Connected components over an edge table, without the driver ever holding an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable over ``edges`` (a, b), for every node that has an edge.

    Each round takes the least label of a node and its neighbours (partial
    aggregation, so a hub is no hot task) and then jumps to the label's own
    label; it ends when nothing changes, as each other round lowers a label. No edges: no rows. Self-loops and
    repeated edges change nothing.
    """
    both = written(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct(), "edges"
    )
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near, "u").select("u", F.least("l", "m").alias("m"), F.col("l").alias("old"))
        step = written(step, "labels")
        up = step.select(F.col("u").alias("m"), F.col("m").alias("up"))
        after = written(
            step.join(up, "m", "left").select("u", F.coalesce(F.least("up", "m"), "m").alias("l"), F.col("old")), "labels"
        )
        label = after.select("u", "l")
        if after.where("l <> old").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
