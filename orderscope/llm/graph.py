"""Connected components by repeated contraction, with joins and partial minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import save


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it reaches.

    Each round points every node at its smallest neighbour (a partial minimum, so a node
    with very many edges costs no more than any other), follows the pointers until they
    end in roots, and replaces the edges by those between different roots. The rounds
    grow with the logarithm of the number of nodes. Edges stay on the executors; the
    driver only learns whether any are left.
    """
    edge = edges.where(F.col(a) != F.col(b))
    edge = save(
        edge.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges"
    )
    labels = None
    while labels is None or not edge.isEmpty():
        up = edge.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        same = edge.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
        parent = save(up.union(same).groupBy("node").agg(F.min("root").alias("root")), "parents")
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            parent = save(
                parent.join(above, "root").select(
                    "node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")
                ),
                "jumped",
            )
            moved = parent.where("moved").isEmpty()
            parent = parent.select("node", "root")
            if moved:
                break
        if labels is None:
            labels = parent
        else:
            new = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = save(
                labels.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root")),
                "labels",
            )
        lo = parent.select(F.col("node").alias("lo"), F.col("root").alias("x"))
        hi = parent.select(F.col("node").alias("hi"), F.col("root").alias("y"))
        edge = save(
            edge.join(lo, "lo")
            .join(hi, "hi")
            .where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
            .distinct(),
            "edges",
        )
    return labels
