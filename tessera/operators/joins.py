"""Joins between edges and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.schema import DEPENDENCY_KINDS


def _prefixed(nodes: DataFrame, side: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def with_endpoints(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both ends; edges with an end that isn't there fall away."""
    return edges.join(_prefixed(nodes, "source", *columns), "source").join(_prefixed(nodes, "target", *columns), "target")


def children(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    inside = edges.where((F.col("source") == node_id) & (F.col("kind") == "contains")).select(F.col("target").alias("id"))
    return nodes.join(inside, "id")


def usages(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Nodes with an edge to node_id that isn't containment, a row for each edge."""
    at = edges.where((F.col("target") == node_id) & (F.col("kind") != "contains")).select(F.col("source").alias("id"), F.col("kind").alias("edge_kind"), "line")
    return nodes.join(at, "id")


def references(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str) -> DataFrame:
    """References from or to a node, containment left out, with the other end's row."""
    own, other = ("source", "target") if direction == "outgoing" else ("target", "source")
    at = edges.where((F.col(own) == node_id) & (F.col("kind") != "contains")).select(F.col(other).alias("id"), F.col("kind").alias("edge_kind"), "line")
    return nodes.join(at, "id")


def file_dependencies(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
    """Different (from_file, to_file) of edges of these kinds between files. One plan for all files."""
    e = with_endpoints(edges.where(F.col("kind").isin(*kinds)), nodes, "file_path")
    return e.where("source_file_path != target_file_path").select(F.col("source_file_path").alias("from_file"), F.col("target_file_path").alias("to_file")).distinct()


def file_dependents(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Files that depend on path by any edge but containment."""
    e = with_endpoints(edges.where("kind != 'contains'"), nodes, "file_path")
    return e.where((F.col("target_file_path") == path) & (F.col("source_file_path") != path)).select(F.col("source_file_path").alias("path")).distinct()


def sound_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between nodes of a set (id)."""
    return sound_edges(edges, ids)


def vanished(tracked: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    return tracked.join(current.select(key).distinct(), key, "left_anti")
