"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import discard, stored


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """The component of every end of edges (a, b): node, component (its least node).

    Each round a node takes the least label among its own and its neighbours', then its label's label, so that chains
    halve. Labels are a stored table after each round; nothing is collected. Ends when no label changes.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        new = stored(lower.join(jump, "next", "left").select("node", F.col("component").alias("old"), F.least("next", F.coalesce("further", "next")).alias("component")), "labels")
        discard(labels)
        settled = new.filter(F.col("old") != F.col("component")).isEmpty()
        labels = new.select("node", "component")
        labels.stored_at = new.stored_at
        if settled:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
