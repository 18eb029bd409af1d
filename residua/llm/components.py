"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from residua.operators.storage import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `component` (the smallest node reachable) for every node of the undirected links.

    Every round takes the smallest label of the neighbours and then the label's own label, so a chain's length
    roughly halves; rounds are stored, and end when no label changes. Null ends are ignored.
    """
    whole = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = materialize(whole.union(whole.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("component").alias("near"))
        smaller = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        heads = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        jumped = smaller.join(heads, "component", "left").select("node", "old", F.least("component", F.coalesce("jump", "component")).alias("component"))
        stored = materialize(jumped, "labels")
        labels = stored.select("node", "component")
        if stored.where("component <> old").isEmpty():
            return labels
