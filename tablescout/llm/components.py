"""Connected components of a table of links, by labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablescout.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every node of ``links(a, b)``; the component is its smallest id.

    Each round a node takes the smallest label among its neighbours and itself, then the label of its
    label. Every round's labels are a written table, so a lost executor costs one round at most.
    The aggregation is combined before the shuffle, so a node with very many links is no hot key.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("_next"), F.col("component").alias("_root"))
        new = materialize(step.join(jump, step["next"] == jump["_next"]).select(
            "id", F.least("next", "_root").alias("component"), (F.least("next", "_root") != F.col("was")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("id", "component")
        labels = new.drop("moved")
