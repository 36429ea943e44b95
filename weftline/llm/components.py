"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """node, comp (smallest node reachable) for every node of an undirected edge table.

    Each round, a node takes the smallest label around it and then its label's label (pointer jumping), so chains shorten
    geometrically. State is a Parquet table in the shared folder; neighbours' labels are reduced by a map-side minimum.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("n"))
        up = labels.select(F.col("u").alias("n"), F.col("l").alias("j"))
        labels = materialize(step.join(up, "n", "left").select("u", F.least("n", F.coalesce("j", "n")).alias("l"), (F.least("n", F.coalesce("j", "n")) < F.col("l")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            break
        labels = labels.select("u", "l")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select(F.col("u").alias("node"), F.col("l").alias("comp"))
