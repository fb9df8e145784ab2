"""Connected components of a table of links, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its smallest node.

    Each round gives a node the smallest label among its neighbours and then the label of
    that label, so paths shorten by half at least. Labels are written to the shared folder
    after each round; the driver sees the number of changes only. Loops and repeated links
    change nothing.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(
        "a <> b").distinct(), "components-links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("label")), "components-labels")
    labels_table = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        low = materialise(low, "components-low")
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        fresh = materialise(low.join(up, "low", "left").select(
            "node", F.least("low", F.coalesce("up", "low")).alias("label"), (F.least("low", F.coalesce("up", "low")) < F.col(
                "label")).alias("changed")), "components-labels")
        discard(labels_table, low)
        labels_table, labels = fresh, fresh.select("node", "label")
        if not fresh.where("changed").limit(1).count():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
