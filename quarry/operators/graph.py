"""Connected components by smallest label, as equi-joins and aggregates per round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import shared_folder


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, root): smallest id reachable. nodes: id; edges: a, b. Lineage is cut by checkpoint() in the shared folder.

    It ends when a round moves nothing; if `rounds` are given and do not suffice, it raises.
    """
    shared_folder(nodes.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    label = both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")).checkpoint()
    for i in count():
        if i == rounds:
            raise RuntimeError(f"connected_components: not settled after {rounds} rounds")
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        step = label.join(near, "id").select("id", F.least("root", "m").alias("root"), (F.col("m") < F.col("root")).alias("moved"))
        # jump to the label of the label
        up = step.select(F.col("id").alias("root"), F.col("root").alias("r2"))
        step = step.join(up, "root", "left").select("id", F.least("root", F.coalesce("r2", "root")).alias("root"), "moved").checkpoint()
        label = step.select("id", "root")
        if not step.where("moved").limit(1).count():
            break
    return nodes.join(label, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
