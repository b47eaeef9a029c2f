"""Symbols that a query names, and the way between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lookup import is_callable
from tessera.plans.schema import CALL_KINDS

#: Nodes that names give at most, and definitions up to which a name counts as nearly unique.
MOST_NAMED, FEW = 40, 3


def cascade(nodes: DataFrame, tokens: list[str]) -> DataFrame:
    """(ord, token, id, level) of the nodes that each token names: by qualified name, else by name, else by a part of names or docstring; the first way that finds any.

    Tokens are the words of one query, so all of them are expressions of one scan. A
    token that comes again counts at its first place.
    """
    tokens = list(dict.fromkeys(tokens))
    if not tokens:
        return nodes.select(F.lit(0).alias("ord"), F.lit("").alias("token"), "id", F.lit(0).alias("level")).limit(0)
    low = [F.lower(c) for c in ("name", "qualified_name", "docstring")]
    ways = [F.struct(F.lit(i).alias("ord"), F.lit(t).alias("token"), F.when(F.col("qualified_name") == t, 0).when(F.col("name") == t, 1).when(F.coalesce(low[0].contains(t.lower()), F.lit(False)) | F.coalesce(low[1].contains(t.lower()), F.lit(False)) | F.coalesce(low[2].contains(t.lower()), F.lit(False)), 2).alias("level")) for i, t in enumerate(tokens)]
    hit = nodes.select("id", F.explode(F.array(*ways)).alias("x")).select("x.ord", "x.token", "id", "x.level").where("level IS NOT NULL")
    best = hit.groupBy("ord").agg(F.min("level").alias("best"))  # one row a token
    return hit.join(F.broadcast(best), "ord").where("level = best").drop("best")


def named_seeds(nodes: DataFrame, tokens: list[str], most: int = MOST_NAMED) -> DataFrame:
    """(id, ord): the nodes that tokens name, in the order of tokens and ids, the first most of them."""
    return cascade(nodes, tokens).groupBy("id").agg(F.min("ord").alias("ord")).orderBy("ord", "id").limit(most)


def one_caller_each(edges: DataFrame, targets: DataFrame, without: DataFrame) -> DataFrame:
    """(id, target): for each of targets (id) its least caller that isn't in without (id); a partial aggregate, so a hub's callers aren't gathered."""
    e = edges.where(F.col("kind").isin(*CALL_KINDS)).select("source", "target")
    e = e.join(targets.select(F.col("id").alias("target")), "target", "left_semi").join(without.select(F.col("id").alias("source")), "source", "left_anti")
    return e.groupBy("target").agg(F.min("source").alias("id")).select("id", "target")


def flow(nodes: DataFrame, edges: DataFrame, tokens: list[str], most: int = MOST_NAMED) -> DataFrame:
    """(id, role, is_unique, place) of the way between callables that two tokens or more name; no rows for fewer.

    named ones stand in the order of files and lines, and are unique if a token names few
    callables besides. Each but the first brings one caller that isn't named itself.
    """
    tokens = list(dict.fromkeys(tokens)) if len(tokens) >= 2 else []
    hit = cascade(nodes, tokens).join(nodes.where(is_callable(F.col("kind"))).select("id", "file_path", "start_line"), "id")
    sizes = hit.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    first = hit.join(F.broadcast(sizes), "ord").groupBy("id", "file_path", "start_line").agg(F.min("ord").alias("ord"), F.max(F.col("n") <= FEW).alias("is_unique")).orderBy("ord", "id").limit(most)
    # at most most rows from here on
    named = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file_path", "start_line", "id")) - 1)
    extra = one_caller_each(edges, named.where("place > 0"), named)
    places = extra.join(F.broadcast(named.select(F.col("id").alias("target"), "place")), "target").groupBy("id").agg(F.min("place").alias("place"))
    return named.select("id", F.lit("named").alias("role"), "is_unique", "place").unionByName(places.select("id", F.lit("caller").alias("role"), F.lit(False).alias("is_unique"), "place"))
