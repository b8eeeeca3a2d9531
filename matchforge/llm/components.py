"""Connected components of a link table, by label spreading with shortcuts; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import discard, write_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b: any type that has an order); component is the smallest node reachable.

    Each round gives every node the smallest label around it (sums per task come first, so a node with very many links
    sends one row per task), and then the label of its label, so that long chains shrink in few rounds. The driver sees one
    count per round. Repeated links and links of a node with itself do not matter. No links give an empty table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = write_table(both, "edges")
    labels = write_table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        spread = write_table(spread, "labels")
        up = spread.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = spread.join(up, F.col("label") == F.col("_n"), "left").select("node", "old", F.coalesce(F.least("label", "_up"), "label").alias("component"))
        jumped = write_table(jumped, "labels")
        done = jumped.where("component <> old").isEmpty()
        discard(spread, labels)
        labels = jumped
        if done:
            discard(edges)
            return labels.select("node", "component")
