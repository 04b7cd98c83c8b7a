"""Navigation graph documents: a JSON object of nodes by id and of outgoing edges by node id, as node, key and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "name: string, type: string, lat: double, lng: double, level: int, description: string"
EDGE = "id: string, to: string, roadName: string, distance: double, time: double, heading: int, status: string, access: array<string>, toll: boolean"
SCHEMA = f"metadata map<string, string>, nodes map<string, struct<{NODE}>>, graph map<string, array<struct<{EDGE}>>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node_id and the node's fields), adjacency keys (node) and edges (edge_id, source, target and the edge's fields)."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = rows.select(F.explode("nodes").alias("node_id", "node")).select("node_id", "node.*")
    lists = rows.select(F.explode("graph").alias("source", "edges"))
    edges = lists.select("source", F.explode("edges").alias("e")).select(
        F.col("e.id").alias("edge_id"), "source", F.col("e.to").alias("target"), F.col("e.roadName").alias("road_name"), "e.distance", "e.time", "e.heading", "e.status", "e.access", "e.toll"
    )
    return nodes, lists.select(F.col("source").alias("node")), edges
