"""Ranking of the files that a search touches, and what of them is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import is_config_leaf, is_generated, is_low_value
from tessera.plans.lineage import cut


@dataclass(frozen=True)
class Budget:
    """How much a result may show, by the project's number of files."""

    chars: int
    files: int
    chars_per_file: int
    gap: int
    header_symbols: int
    relations_per_kind: int
    #: Whether relations and notes are shown; a small project instead leaves out files of low value.
    full: bool

    min_files: int = 2


# Budgets below 150, 500 and 5000 files, and from there on.
BUDGETS = ((150, Budget(13_000, 4, 3_800, 7, 5, 4, False)), (500, Budget(18_000, 5, 3_800, 8, 6, 6, False)), (5_000, Budget(24_000, 8, 6_500, 12, 10, 10, True)), (None, Budget(24_000, 8, 7_000, 15, 15, 15, True)))
NAMED, ENTRY, NEAR, OTHER, LEAST_FILE_SCORE, GATE = 50, 10, 3, 1, 3, 0.06
WHOLE_LINES, WHOLE_LINES_CENTRAL, LINE_CHARS = 220, 280, 80


def budget(files: int) -> Budget:
    return next(b for most, b in BUDGETS if most is None or files < most)


def budget_columns(files: Column) -> dict[str, Column]:
    """budget() of a column of numbers of files: a column for each of its fields."""
    out = {}
    for name in ("chars", "files", "chars_per_file", "gap", "header_symbols", "relations_per_kind"):
        value = F.lit(getattr(BUDGETS[-1][1], name))
        for most, b in reversed(BUDGETS[:-1]):
            value = F.when(files < most, getattr(b, name)).otherwise(value)
        out[name] = value
    return out


def countable(nodes: DataFrame) -> DataFrame:
    """Nodes that count for their file: no imports, exports or leaves of a configuration."""
    return nodes.where(~F.col("kind").isin("import", "export") & ~is_config_leaf(F.col("kind"), F.col("name"), F.col("qualified_name")))


def without_low_value(files: DataFrame, least: int = 2) -> DataFrame:
    """files (file_path, ...) without those of low value, if least others are there; else all."""
    n = files.agg(F.sum((~is_low_value(F.col("file_path"))).cast("int"))).first()[0] or 0
    return files.where(~is_low_value(F.col("file_path"))) if n >= least else files


def central(files: DataFrame, most: int = 2) -> DataFrame:
    """(file_path) of the files of the highest graph scores (file_path, graph_score, hits) that have a term."""
    return files.where("hits >= 1 AND graph_score > 0").orderBy(F.desc("graph_score"), "file_path").limit(most).select("file_path")


def gated(files: DataFrame, least: int = 2) -> DataFrame:
    """Files (file_path, named, central, hits, graph_score, ...) that pass: by a share of the highest graph score, as a central or entry one, or by two hits; all if fewer than least do."""
    top, n = _top(files)
    if not top:
        return files
    f = files.where(_passes(files, top))
    return f if n >= least else files


def _passes(files: DataFrame, top: float) -> Column:
    entry = F.col("entry") if "entry" in files.columns else F.col("named")
    return (F.col("graph_score") >= GATE * top) | F.col("named") | F.col("central") | entry | (F.col("hits") >= 2)


def _top(files: DataFrame) -> tuple[float, int]:
    """The highest graph score, and how many files pass by it."""
    top = files.agg(F.max("graph_score")).first()[0] or 0.0
    return top, (files.where(_passes(files, top)).count() if top else 0)


def file_scores(nodes: DataFrame, named: DataFrame, entries: DataFrame, near: DataFrame) -> DataFrame:
    """(file_path, score, n) of a subgraph's nodes by whether each is named, an entry, next to one, or else."""
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    n = nodes.join(mark(named, "named"), "id", "left").join(mark(entries, "entry"), "id", "left").join(mark(near, "near"), "id", "left")
    points = F.when(F.col("named"), NAMED).when(F.col("entry"), ENTRY).when(F.col("near"), NEAR).otherwise(OTHER)
    return n.groupBy("file_path").agg(F.sum(points).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("score") >= LEAST_FILE_SCORE)


def graph_scores(nodes: DataFrame, walk: DataFrame) -> DataFrame:
    """(file_path, graph_score) by the walk's mass on the file's nodes."""
    return nodes.join(walk, "id").groupBy("file_path").agg(F.sum("score").alias("graph_score"))


def term_hits(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(file_path, hits): how many different terms stand in a file's path or in a name in it."""
    low = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 3]
    flags = [F.max((F.lower("name").contains(t) | F.lower("file_path").contains(t)).cast("int")).alias(f"t{i}") for i, t in enumerate(low)]
    if not flags:
        return nodes.select("file_path").distinct().withColumn("hits", F.lit(0))
    g = nodes.groupBy("file_path").agg(*flags)
    return g.select("file_path", sum((F.col(f"t{i}") for i in range(len(low))), F.lit(0)).alias("hits"))


def ranked(files: DataFrame, limit: int) -> DataFrame:
    """Files (file_path, named, central, hits, graph_score, score, n) by eight keys, after the gate.

    Graph scores are compared in steps of 1 % of the highest, so that the order is one.
    entry, if there, marks files of entry nodes, which pass and rank as central ones do.
    """
    files = cut(files)
    top = files.agg(F.max("graph_score")).first()[0] or 0.0
    f = gated(files)
    step = F.floor(F.col("graph_score") / (0.01 * top)) if top > 0 else F.floor(F.col("graph_score"))
    middle = F.col("central") | F.col("entry") if "entry" in files.columns else F.col("central")
    order = [F.desc("named"), (middle & (F.col("hits") >= 2)).desc(), step.desc(), F.desc("hits"), is_low_value(F.col("file_path")).asc(), is_generated(F.col("file_path")).asc(), F.desc("score"), F.desc("n"), "file_path"]
    return f.orderBy(*order).limit(limit)


def render_mode(lines: Column, central: Column, god_file: Column, sibling: Column, chars_per_file: int) -> Column:
    """How a file is shown: its skeleton, whole, or in clusters."""
    whole = (lines <= F.when(central, WHOLE_LINES_CENTRAL).otherwise(WHOLE_LINES)) & (lines * LINE_CHARS <= 3 * chars_per_file)
    return F.when(god_file | sibling, "skeleton").when(whole, "whole").otherwise("clustered")
