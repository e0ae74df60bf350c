"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.skew import materialise, salted_join


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v): comp is the smallest node reachable.

    Each round takes the least label among neighbours, then the label of that label (pointer
    jumping), so the number of rounds grows slowly with the diameter. A node with very many
    neighbours is joined over salts. Every round is a written table.
    """
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                       .where("u is not null and v is not null and u <> v").distinct(), "graph-edges")
    total = both.count()
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(
        F.count(F.lit(1)).alias("deg"), F.least(F.col("u"), F.min("v")).alias("comp")), "graph-labels")
    for _ in range(rounds):
        near = (salted_join(both.select(F.col("v").alias("node"), "u"), labels, ["node"], [F.col("u")], "deg", total)
                .groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("_near")))
        lower = materialise(labels.join(near, "node").select(
            "node", "deg", F.least("comp", "_near").alias("comp"), (F.col("_near") < F.col("comp")).alias("_moved")),
            "graph-lower")
        # the label of the label; only distinct labels are looked up
        roots = lower.select(F.col("comp").alias("_l")).groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
        jump = (roots.join(lower.select(F.col("node").alias("_l"), F.col("comp").alias("_root")), "_l")
                .withColumnRenamed("_l", "comp"))
        labels = materialise(salted_join(lower, materialise(jump, "graph-roots"), ["comp"], [F.col("node")], "_n", total)
                             .select("node", "deg", F.least("comp", "_root").alias("comp"),
                                     (F.col("_moved") | (F.col("_root") < F.col("comp"))).alias("_moved")), "graph-labels")
        if labels.where("_moved").isEmpty():
            return labels.select("node", "comp")
        labels = labels.drop("_moved")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
