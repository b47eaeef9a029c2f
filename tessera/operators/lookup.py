"""Lookups and filters over nodes and edges: pure plans, whose filters reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Nodes of a stated list of ids; none for none."""
    return nodes.where(F.col("id").isin(ids)) if ids else nodes.limit(0)


def existing(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id) with whether there is such a node."""
    has = nodes.select("id").distinct().withColumn("found", F.lit(True))
    return wanted.join(has, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def by_qualified_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("qualified_name") == name)


def by_lower_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.lower("name") == name.lower())


def by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def page(df: DataFrame, offset: int, limit: int, order: str = "id") -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def _of_kinds(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds)) if kinds else df


def search(nodes: DataFrame, query: str, kinds: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Nodes with query in name, qualified name or docstring, without case; wildcards in it stand for themselves. A limit takes the first by id."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.lower("qualified_name").contains(q) | F.coalesce(F.lower("docstring").contains(q), F.lit(False))
    found = _of_kinds(nodes.where(hit), kinds)
    return found.orderBy("id").limit(limit) if limit is not None else found


def name_substring(nodes: DataFrame, part: str, limit: int, kinds: tuple[str, ...] = (), exclude_prefix: bool = False) -> DataFrame:
    low = F.lower("name")
    hit = low.contains(part.lower())
    if exclude_prefix:
        hit &= ~low.startswith(part.lower())
    return _of_kinds(nodes.where(hit), kinds).orderBy("id").limit(limit)


def outgoing(edges: DataFrame, node_id: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    return _of_kinds(edges.where(F.col("source") == node_id), kinds)


def incoming(edges: DataFrame, node_id: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    return _of_kinds(edges.where(F.col("target") == node_id), kinds)


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: * any run, ? any character, all else itself."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob) + "$"


def by_glob(nodes: DataFrame, glob: str) -> DataFrame:
    return nodes.where(F.lower("qualified_name").rlike(glob_pattern(glob.lower())))


def exported(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("file_path") == path) & F.col("is_exported"))


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """Nodes by qualified name, else by name, else by lower-cased name: the first level that finds any."""
    level = F.when(F.col("qualified_name") == symbol, 0).when(F.col("name") == symbol, 1).when(F.lower("name") == symbol.lower(), 2)
    found = nodes.withColumn("level", level).where("level IS NOT NULL")
    best = found.agg(F.min("level").alias("best"))
    return found.join(F.broadcast(best), found["level"] == best["best"]).drop("best")


def pick_by_file(candidates: DataFrame, file: str | None) -> DataFrame:
    """One candidate: the first whose path contains file, else the first; first by id."""
    hit = F.col("file_path").contains(file) if file else F.lit(False)
    return candidates.orderBy(hit.desc(), "id").limit(1)


def symbol(nodes: DataFrame, name: str, file: str | None = None) -> DataFrame:
    return pick_by_file(resolve_symbol(nodes, name), file)


def without_kinds(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return edges.where(~F.col("kind").isin(*kinds))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def view_row(nodes: DataFrame) -> DataFrame:
    """The six columns of a viewer's node, without imports and exports."""
    return nodes.where(~F.col("kind").isin("import", "export")).select("id", "kind", "name", "qualified_name", "file_path", "start_line")


def is_callable(kind: Column) -> Column:
    return kind.isin("method", "function", "component", "constructor")


def decoded_nodes(rows: DataFrame) -> DataFrame:
    """Nodes from rows as a relational store has them: flags as 0 or 1, lists as JSON text, null for an empty list."""
    flags, lists = [c for c in rows.columns if c.startswith("is_")], [c for c in ("decorators", "type_parameters") if c in rows.columns]
    return rows.withColumns({c: F.col(c) == 1 for c in flags} | {c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in lists})


def encoded_nodes(nodes: DataFrame) -> DataFrame:
    """What decoded_nodes reads."""
    flags, lists = [c for c in nodes.columns if c.startswith("is_")], [c for c in ("decorators", "type_parameters") if c in nodes.columns]
    return nodes.withColumns({c: F.col(c).cast("int") for c in flags} | {c: F.when(F.size(c) > 0, F.to_json(c)) for c in lists})


def decoded_edges(rows: DataFrame) -> DataFrame:
    """Edges whose metadata is JSON text."""
    return rows.withColumn("metadata", F.from_json("metadata", "map<string,string>"))


def of_known_kind(nodes: DataFrame, kind: str | None, known: tuple[str, ...]) -> DataFrame:
    """Nodes of a kind; all for none or one that there isn't."""
    return by_kind(nodes, kind) if kind in known else nodes


def under(nodes: DataFrame, prefix: str | None) -> DataFrame:
    """Nodes in files whose path begins so."""
    return nodes.where(F.col("file_path").startswith(prefix)) if prefix else nodes
