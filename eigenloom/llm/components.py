"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.session import materialise, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    ``edges`` (a, b) are undirected, of one integer type, with repeats, both
    directions or loops as they come; null ends are ignored. Returns
    (node, label). Each round hands the smallest neighbouring label to a node
    and to the node that its label names, then follows labels once, so chains
    and stars both shrink in a logarithm of their size. Sums of labels fall
    until nothing changes; no links come to the driver. The tables of a round
    are written to the shared folder, which lets adaptive execution split a hub.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialise(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "component-labels")
    weight = F.sum(F.col("label").cast("decimal(38,0)"))
    last = labels.agg(weight).first()[0]
    for _ in range(max_rounds if last is not None else 0):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", "label", "near")
        offered = own.select(
            F.explode(F.array(F.struct("node", F.least("label", "near").alias("label")), F.struct(F.col("label").alias("node"), F.col("near").alias("label")))).alias("x")
        ).select("x.node", "x.label")
        lower = materialise(offered.groupBy("node").agg(F.min("label").alias("label")), "component-lower")
        up = lower.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        after = materialise(lower.join(up, lower["label"] == up["up_node"]).select("node", F.least("label", "up_label").alias("label")), "component-labels")
        release(labels)
        release(lower)
        labels = after
        now = labels.agg(weight).first()[0]
        if now == last:
            return labels
        last = now
    if last is not None:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels
