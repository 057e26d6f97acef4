"""Connected components of an edge list, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge is connected with.

    Each round links every node to its smallest neighbour, follows those links twice over
    and contracts the edges; a round's tables are checkpointed, so lineage stays short and
    a lost executor costs one round.  Null ends and loops are no edges; repeated edges count
    once; an empty table gives an empty result; other columns play no part.
    """
    shared_dir(edges.sparkSession)
    kind = edges.schema[a].dataType
    links = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y").distinct().checkpoint()
    nodes = links.select(F.col("x").alias("node")).union(links.select("y")).distinct().withColumn("component", F.col("node").cast(kind))
    first = True
    while first or not links.isEmpty():
        up = links.select(F.col("y").alias("v"), F.col("x").alias("p")).groupBy("v").agg(F.min("p").alias("p"))
        for _ in range(2):
            over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = up.join(over, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        up = up.checkpoint()
        to = lambda df, c: df.join(up.select(F.col("v").alias(c), F.col("p").alias(f"{c}_to")), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
        nodes = to(nodes, "component").checkpoint()
        moved = to(to(links, "x"), "y")
        links = moved.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct().checkpoint()
        first = False
    return nodes
