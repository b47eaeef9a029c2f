"""An inverted index over nodes' names and texts, kept up with changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that are indexed.
FIELDS = ("name", "qualified_name", "docstring", "signature")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of a text, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def build(nodes: DataFrame) -> DataFrame:
    """(token, id, n): how often each token stands in each node's indexed columns."""
    there = [c for c in FIELDS if c in nodes.columns]
    return nodes.select("id", F.explode(F.concat(*(tokens(F.col(c)) for c in there))).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("n"))


def refreshed(index: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """The index after nodes were inserted or updated (changed, whole rows) and deleted (gone, id): rows of other nodes stay as they are."""
    touched = changed.select("id").union(gone.select("id")).distinct()
    return index.join(touched, "id", "left_anti").select("token", "id", "n").unionByName(build(changed))


def matching(index: DataFrame, words: list[str]) -> DataFrame:
    """(id, n) of nodes that have all of some words, by how often they have them."""
    wanted = list(dict.fromkeys(w.lower() for w in words))
    hit = index.where(F.col("token").isin(wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
    return hit.where(F.col("words") == len(wanted)).select("id", "n")
