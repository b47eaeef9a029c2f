"""Parts of a graph as pairs of nodes and edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Subgraph(NamedTuple):
    """Nodes (id, ...), each once, and edges (source, target, kind, ...), which may repeat."""

    nodes: DataFrame
    edges: DataFrame

    def merged(self, other: Subgraph) -> Subgraph:
        """Both: a node that both have is there once, as the first has it, and edges come together as they are."""
        own = self.nodes.select(*self.nodes.columns)
        new = other.nodes.select(*self.nodes.columns).join(own.select("id"), "id", "left_anti")
        return Subgraph(own.unionByName(new.select(*own.columns)), self.edges.unionByName(other.edges.select(*self.edges.columns)))


def connected(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(id) of the other ends of edges at entries (id)."""
    ids = entries.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    back = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    return out.union(back).distinct()


def entries(roots: DataFrame, named: DataFrame) -> DataFrame:
    """(id) of search roots and named nodes."""
    return roots.select("id").union(named.select("id")).distinct()


def files_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(file_path) of nodes with these ids (id)."""
    return nodes.join(ids.select("id"), "id", "left_semi").select("file_path").distinct()


def in_same_files(nodes: DataFrame, ids: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Nodes that stand in a file of one of ids (id), which are among every, by default nodes."""
    return nodes.join(files_of(nodes if every is None else every, ids), "file_path", "left_semi")
