"""Breadth-first fixpoints as loops of distributed joins.

Each round joins the frontier with edges, leaves out what was seen, and is cut off
from its lineage by a reliable checkpoint, so plans don't grow with depth and a lost
executor costs one round at most. A frontier of few rows, which are counted first, is
broadcast, so edges stay where they are; a larger one meets them in a sort-merge join.
Levels are appended: what was seen before isn't written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

#: Rows of a frontier that are broadcast at most: some ten MB of ids.
BROADCAST_ROWS = 100_000
#: Levels that stay apart before they are written as one.
LEVELS_APART = 24


def priority() -> Column:
    """The order in which edges are followed."""
    return F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)


def oriented(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Edges as steps (at, to, kind, line, incoming), along them, against them, or both."""
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "kind", "line", F.lit(False).alias("incoming"))
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"), "kind", "line", F.lit(True).alias("incoming"))
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"no direction {direction!r}")
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, to be joined: broadcast where it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fresh(found: DataFrame, rows: int, seen: list[DataFrame]) -> DataFrame:
    """Rows of found, so many with an id each, whose id isn't in seen. Of few rows those seen are looked up where seen lies."""
    before = union_all([s.select("id") for s in seen])
    if rows > BROADCAST_ROWS:
        return found.join(before.hint("merge"), "id", "left_anti")
    known = before.join(F.broadcast(found.select("id")), "id", "left_semi")
    return found.join(F.broadcast(known), "id", "left_anti")


class _Loop:
    """Levels of a breadth-first fixpoint, each written once."""

    def __init__(self, start: DataFrame) -> None:
        first = cut(start)
        self.levels, self.frontier, self.rows = [first], first, first.count()
        self.total, self.seen = self.rows, [first]

    def go(self, found: DataFrame) -> bool:
        """Take up what a round found, each id once; whether any of it is new."""
        found = cut(found)
        new = cut(fresh(found, found.count(), self.seen))
        self.rows = new.count()
        if not self.rows:
            return False
        self.total += self.rows
        self.levels.append(new)
        self.frontier = new
        self.seen.append(new)
        if len(self.seen) > LEVELS_APART:
            self.seen = [cut(union_all([s.select("id") for s in self.seen]))]
        return True


def _rounds(start: DataFrame, steps: DataFrame, found, depth: int | None, allowed: DataFrame | None, enough: int | None, goal: str | None) -> list[DataFrame]:
    loop, level = _Loop(start), 0
    while loop.rows and (depth is None or level < depth) and (enough is None or loop.total < enough):
        level += 1
        near = steps.join(sized(loop.frontier.select(F.col("id").alias("at")), loop.rows), "at").withColumnRenamed("to", "id")
        if allowed is not None:
            near = near.join(allowed.select("id"), "id", "left_semi")
        if not loop.go(found(near, level)):
            break
        if goal is not None and not loop.frontier.where(F.col("id") == goal).isEmpty():
            break
    return loop.levels


def levels(steps: DataFrame, starts: DataFrame, depth: int | None = None, allowed: DataFrame | None = None, enough: int | None = None, goal: str | None = None) -> DataFrame:
    """(id, level) of all that starts (id) reach by steps (at, to) in at most depth rounds; level is the least number of steps.

    allowed (id) are the nodes that may be entered; others are neither kept nor passed.
    With enough, no further level is begun once that many ids are there; with goal, once
    it is reached.
    """
    start = starts.select("id").distinct().withColumn("level", F.lit(0))
    return union_all(_rounds(start, steps, lambda near, level: near.select("id").distinct().withColumn("level", F.lit(level)), depth, allowed, enough, goal))


def tree_levels(steps: DataFrame, starts: DataFrame, depth: int | None = None, allowed: DataFrame | None = None, enough: int | None = None, goal: str | None = None) -> list[DataFrame]:
    """The levels of tree(), each by itself."""
    none = F.lit(None).cast("string")
    start = starts.select("id").distinct().select("id", F.lit(0).alias("level"), none.alias("parent"), none.alias("kind"))

    def found(near: DataFrame, level: int) -> DataFrame:
        # the least step of each node is a partial aggregate, so a node that many steps reach isn't gathered
        best = near.groupBy("id").agg(F.min(F.struct(priority().alias("p"), "incoming", "at", "kind")).alias("x"))
        return best.select("id", F.lit(level).alias("level"), F.col("x.at").alias("parent"), F.col("x.kind").alias("kind"))

    return _rounds(start, steps, found, depth, allowed, enough, goal)


def tree(steps: DataFrame, starts: DataFrame, depth: int | None = None, allowed: DataFrame | None = None, enough: int | None = None) -> DataFrame:
    """(id, level, parent, kind) of a breadth-first tree: each node by the step of least (priority, incoming, parent, kind) from the level before."""
    return union_all(tree_levels(steps, starts, depth, allowed, enough))


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each group, the first by order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
