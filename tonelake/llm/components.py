"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` of all ends of ``edges`` (columns a, b): the least node of each component.

    Every round takes the least label next door, then the label of that label, so rounds grow with the
    logarithm of a component's width. Hubs are reduced before the shuffle; labels are stored tables, so a
    join of a hot label is split by the adaptive plan. Raises where ``rounds`` don't settle all labels.
    """
    both = settle(edges.filter("a != b").select("a", "b").unionAll(edges.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = settle(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "labels-near")
        above = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = settle(step.join(above, "label").select("node", F.least("label", "above").alias("label"), "old"), "labels")
        if labels.filter("label != old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
