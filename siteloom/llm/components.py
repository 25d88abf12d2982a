"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.scale import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root (least node reachable) for every node of a link. Every round takes the
    least label among a node and its neighbours and then the label of that label, each as a join and
    a map-side minimum, and is written to the shared folder; rounds follow the logarithm of the longest
    shortest path on usual graphs. Null ends are left out."""
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    edges = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = labels.join(near, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        step = written(least, "least")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = written(step.join(jump, "root", "left").select(
            "node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = step.select("node", "root")
        if step.filter("root <> old").isEmpty():
            return labels
