"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.llm.common import discard, materialize


EDGES_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node, class`` for every node of ``edges (a, b)``; the class is the smallest node in it.

    Each round gives a node the smallest label among its neighbours and then that label's own
    label, so long chains shorten geometrically. Each round's labels are written to the shared
    folder. No node's neighbours are gathered: the minimum is combined before the shuffle.
    """
    # Tasks follow the number of edges, so that few edges are not dealt over hundreds of tiny tasks.
    tasks = max(8, edges.count() // EDGES_PER_TASK)
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct().coalesce(tasks), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("class"))
                         .select("node", "class").coalesce(tasks), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("class").alias("near")))
        lower = (labels.join(near, "node")
                 .select("node", F.col("class").alias("old"), F.least("class", "near").alias("class")))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("far"))
        after = materialize(lower.join(jump, "class", "left").select(
            "node", "old", F.least("class", F.coalesce("far", "class")).alias("class")).coalesce(tasks), "labels")
        changed = not after.filter("old != class").isEmpty()
        discard(labels)
        labels = after.select("node", "class")
        if not changed:
            discard(both)
            return labels
