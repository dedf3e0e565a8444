"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the (a, b) edges: the least node that it can reach.

    Each round takes the least label among neighbours and then the label of
    that label, so long chains shrink fast. Every round is a written table:
    neither links nor labels go to the driver, only one sum.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    before = None
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(around, "node").select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def extended(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, label) after more (a, b) edges: only the labels that they connect are worked on."""
    if labels is None:
        return components(edges)
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    known = edges.join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    known = written(known, "new-edges")
    merged = components(known.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    nodes = known.select(F.col("a").alias("node"), F.col("la").alias("label")).union(known.select("b", "lb")).union(labels).distinct()
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return written(nodes.join(to, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
