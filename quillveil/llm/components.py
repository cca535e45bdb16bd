"""Connected components by minimum labels and pointer jumping, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.store import stored


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Rows (node, label) for every node of the edges (u, v): the smallest node that links lead to.

    Each round a node takes the smallest label among its own and its neighbours', then that node's label. Tables are written
    in the shared folder each round; only whether any label changed goes to the driver.
    """
    both = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        taken = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = stored(taken.join(jump, "new").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("changed")))
        labels = after.select("node", "label")
        if not after.where("changed").limit(1).count():
            return labels
    raise RuntimeError("labels still change")
