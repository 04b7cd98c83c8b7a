"""Connected components of an edge table by repeated star contraction, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    In each round every node hands the smallest node it knows to all its neighbours and to itself. Edges only ever move
    towards smaller roots; the loop ends when a round leaves the edges as they are (by their number and the sum of their
    hashes), which is when each joins a node with its root, after about log(diameter) rounds. Neighbours are never collected: minima are partial aggregates, and a hub's rows meet one row of the minima
    table, so a skewed join can be split. Each round is written to the shared folder.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    links, seen = materialize(links, "links"), None
    for _ in range(max_rounds):
        both = links.select("node", "root").unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = both.groupBy("node").agg(F.min("root").alias("low")).withColumn("low", F.least("low", "node"))
        spread = both.join(lowest, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        own = lowest.select("node", F.col("low").alias("root"))
        links = materialize(spread.unionByName(own).filter("node <> root").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return links.unionByName(links.select(F.col("root").alias("node"), "root").distinct())
