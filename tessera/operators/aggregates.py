"""Aggregations over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import directory_of, is_plain_test

#: Kinds with code worth a blast radius. Fixed values.
MEANINGFUL_KINDS = ("function", "method", "class", "interface", "struct", "trait", "protocol", "enum", "type_alias", "component", "constant", "variable", "property", "field")


def by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def kinds(rows: DataFrame) -> DataFrame:
    """(kind): the kinds that are there."""
    return rows.select("kind").distinct()


def kinds_by_file(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each file with the number of its nodes of each kind."""
    return nodes.groupBy("file_path").pivot("kind", list(kinds)).count().na.fill(0)


def capped_by_kind(edges: DataFrame, cap: int) -> DataFrame:
    """(kind, source, target, rank): the first cap edges of each kind by their ends. Each task cuts its rows down before the exchange."""
    w = Window.partitionBy("kind").orderBy("source", "target", "line")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("kind", "source", "target", "rank")


def symbols_per_file(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def files_by_directory(nodes: DataFrame) -> DataFrame:
    """Directories with their files in order; a directory's files are names alone, so one row holds them."""
    files = nodes.select("file_path").distinct().withColumn("dir", directory_of(F.col("file_path")))
    return files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("file_path")), ",").alias("files"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every node: degrees, calls out and in, children, and whether nothing but containment leads to it.

    Both sides are summed before they meet, so a hub's edges are never gathered.
    """
    calls = F.col("kind").isin("calls", "instantiates")
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum(calls.cast("long")).alias("call_count"), F.sum((F.col("kind") == "contains").cast("long")).alias("child_count"))
    back = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"), F.sum(calls.cast("long")).alias("caller_count"), F.sum((F.col("kind") != "contains").cast("long")).alias("uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(out, "id", "left").join(back, "id", "left").select("id", *map(zero, ("in_degree", "out_degree", "call_count", "caller_count", "child_count")), (F.coalesce("uses", F.lit(0)) == 0).alias("is_dead_code"))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("method", "function", "class")) -> DataFrame:
    """Nodes of these kinds that aren't exported and that only containment leads to."""
    used = edges.where("kind != 'contains'").select(F.col("target").alias("id")).distinct()
    return nodes.where(F.col("kind").isin(*kinds) & ~F.col("is_exported")).join(used, "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Each endpoint's number of edges; an edge to itself counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_by_degree(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    n = nodes.where(~F.col("kind").isin("parameter", "import"))
    return n.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id").limit(limit)


def node_size(degree: F.Column) -> F.Column:
    return F.least(F.greatest(5 + 3 * degree, F.lit(5)), F.lit(40))


def supertypes(edges: DataFrame, least: int = 3) -> DataFrame:
    """Types with at least so many different implementers."""
    return edges.where(F.col("kind").isin("extends", "implements")).groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n")).where(F.col("n") >= least)


def polymorphic_siblings(edges: DataFrame, least: int = 3) -> DataFrame:
    """Types one of whose supertypes has at least so many implementers."""
    up = edges.where(F.col("kind").isin("extends", "implements")).select(F.col("source").alias("id"), F.col("target").alias("super"))
    return up.join(supertypes(edges, least).select(F.col("id").alias("super")), "super", "left_semi").select("id").distinct()


def relations_by_kind(edges: DataFrame, nodes: DataFrame, cap: int) -> DataFrame:
    """For each kind the first cap relations by name, and how many more there are."""
    names = nodes.select("id", "name")
    e = edges.join(names.select(F.col("id").alias("source"), F.col("name").alias("source_name")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target")
    counts = e.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    # a kind's first rows are a top-k, which each task cuts down before the exchange
    w = Window.partitionBy("kind").orderBy("source_name", "target_name", "source", "target")
    first = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return first.join(F.broadcast(counts), "kind").select("kind", "rank", "source_name", "target_name", (F.col("total") - cap).alias("more"))


def first_roots(nodes: DataFrame, roots: DataFrame, most: int = 5, order: str = "id") -> DataFrame:
    """The first most of roots (id, ...) of a kind that a blast radius is shown for."""
    return roots.join(nodes.where(F.col("kind").isin(*MEANINGFUL_KINDS)).select("id"), "id", "left_semi").orderBy(order).limit(most)


def blast_radius(nodes: DataFrame, edges: DataFrame, roots: DataFrame, files: int = 4) -> DataFrame:
    """For each root (id) of a meaningful kind with callers: their number, and its first files with tests and without."""
    kinds = ("calls", "references", "imports", "instantiates")
    r = nodes.where(F.col("kind").isin(*MEANINGFUL_KINDS)).join(roots.select("id"), "id", "left_semi").select(F.col("id").alias("target"))
    callers = edges.where(F.col("kind").isin(*kinds)).join(r, "target", "left_semi").select("target", F.col("source").alias("id")).distinct().join(nodes.select("id", "file_path"), "id")
    counts = callers.groupBy("target").agg(F.count(F.lit(1)).alias("callers"))
    per_file = callers.select("target", "file_path").distinct().withColumn("test", is_plain_test(F.col("file_path")))
    w = Window.partitionBy("target", "test").orderBy("file_path")
    few = per_file.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= files)
    lists = few.groupBy("target").agg(F.array_join(F.sort_array(F.collect_list(F.when(~F.col("test"), F.col("file_path")))), ",").alias("files"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("test"), F.col("file_path")))), ",").alias("tests"))
    return counts.join(lists, "target").select(F.col("target").alias("id"), "callers", "files", "tests", (F.col("tests") == "").alias("untested"))
