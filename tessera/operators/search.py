"""Relevance search: channels of scored hits, boosts, cuts, and expansion around the best.

A query is one short string, so its symbols and terms are known on the driver; each
channel is one scan of nodes with an expression over them, without a join by LIKE.
Channels' rows (id, score) are at most a small multiple of the limit before they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import RANKED_TEST_WORDS, directory_of, is_test, mentions_tests, name_of
from tessera.functions.text import is_distinctive, split_camel, stems, symbols, terms, title_case
from tessera.plans.fixpoint import levels, oriented
from tessera.plans.graph import PropertyGraph
from tessera.plans.lineage import cut

# Scores, and the kinds that channels look at.
QUALIFIED_SCORE, NAME_SCORE, COLOCATED, PREFIX_SCORE, TERM_SCORE, TERM_STEP = 80.0, 70.0, 20.0, 15.0, 10.0, 5.0
TEST_PENALTY, LEAST_SCORE, SEARCH_LIMIT, DEPTH = 0.3, 0.2, 10, 3
PREFIX_KINDS = ("class", "interface", "struct", "enum")
TERM_KINDS = ("file", "module", "class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field", "variable", "constant", "enum", "type_alias", "route", "component")
RELEVANT_KINDS = ("contains", "calls", "imports", "extends", "implements", "references", "instantiates", "overrides", "type_of")


def _sum(columns: list[Column], zero=0) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(zero))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def brevity(name: Column, term: str, base: float, divisor: float) -> Column:
    return F.greatest(F.lit(0.0), base - (F.length(name) - len(term)) / divisor)


def matches(text: Column, part: str) -> Column:
    return F.coalesce(F.lower(text).contains(part.lower()), F.lit(False))


def path_relevance(path: Column, query: str) -> Column:
    """For each word of the query: 10 if a part of it is in the file's name, else 5 if in its directories, else 3 if in the path; less 15 for a test file unless tests are meant."""
    name, dirs, low = F.lower(name_of(path)), F.lower(directory_of(path)), F.lower(path)
    score = []
    for word in [w for w in query.split() if len(w) >= 3]:
        parts = [p.lower() for p in split_camel(word).replace("_", " ").split() if len(p) >= 3] or [word.lower()]
        tier = lambda where, parts=parts: _any([where.contains(p) for p in parts])
        score.append(F.when(tier(name), 10).when(tier(dirs), 5).when(tier(low), 3).otherwise(0))
    penalty = F.lit(0) if mentions_tests(query, RANKED_TEST_WORDS) else F.when(is_test(path), -15).otherwise(0)
    return _sum(score) + penalty


def exact_hits(nodes: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """(id, score) of nodes by qualified name or name; where names of one file are hit together each gains; the best 2 * limit."""
    if not wanted:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    hit = nodes.select("id", F.lower("name").alias("low"), "file_path", F.when(F.col("qualified_name").isin(wanted), QUALIFIED_SCORE).when(F.col("name").isin(wanted), NAME_SCORE).alias("score")).where("score IS NOT NULL")
    together = colocated(hit.withColumnRenamed("low", "name"))
    boosted = hit.join(together, "file_path").select("id", (F.col("score") + F.when(F.col("n") > 1, (F.col("n") - 1) * COLOCATED).otherwise(0.0)).alias("score"))
    return best_first(boosted, 2 * limit)


def prefix_hits(nodes: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """(id, score) of types whose names begin with a title-cased symbol or stem of one; those in title case already aren't looked for."""
    heads = list(dict.fromkeys(title_case(v) for s in wanted for v in (s, *stems(s)) if title_case(v) != v))
    if not heads:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    best = F.greatest(F.lit(-1.0), *[F.when(F.col("name").startswith(h), PREFIX_SCORE + brevity(F.col("name"), h, 10.0, 3.0)).otherwise(-1.0) for h in heads])
    found = nodes.where(F.col("kind").isin(*PREFIX_KINDS)).select("id", best.alias("score")).where("score > 0")
    return best_first(found, 3 * limit)


def term_counts(nodes: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, n): how many of the terms stand in each node's names or docstring, where any does."""
    n = _sum([(matches(F.col("name"), t) | matches(F.col("qualified_name"), t) | matches(F.col("docstring"), t)).cast("int") for t in wanted])
    return nodes.where(F.col("kind").isin(*TERM_KINDS)).select("id", n.alias("n")).where("n > 0")


def colocated(hits: DataFrame) -> DataFrame:
    """(file_path, n): how many different names are hit in each file (name, file_path)."""
    return hits.groupBy("file_path").agg(F.countDistinct(F.lower("name")).alias("n"))


def best_first(hits: DataFrame, most: int) -> DataFrame:
    """The first most hits (id, score, ...) by score, then by id."""
    return hits.orderBy(F.desc("score"), "id").limit(most)


def penalized(score: Column, path: Column, query: str) -> Column:
    """A score lowered for test files, unless the query means tests."""
    return score if "test" in query.lower() else F.when(is_test(path), score * TEST_PENALTY).otherwise(score)


def finalized(hits: DataFrame, limit: int = SEARCH_LIMIT, least: float = LEAST_SCORE) -> DataFrame:
    """The best 3 * limit hits, of these the ones of a least score, of these the first limit."""
    return best_first(best_first(hits, 3 * limit).where(F.col("score") >= least), limit)


def first_channel(hits: DataFrame) -> DataFrame:
    """(id, score) of hits (id, score, c) of several channels: the channel of least c has the say."""
    return hits.groupBy("id").agg(F.min(F.struct("c", (-F.col("score")).alias("s"))).alias("x")).select("id", (-F.col("x.s")).alias("score"))


def term_hits(nodes: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """(id, score) of nodes by how many terms their names or docstrings contain; the best 3 * limit."""
    if not wanted:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    return best_first(term_counts(nodes, wanted).select("id", (TERM_SCORE + TERM_STEP * (F.col("n") - 1)).alias("score")), 3 * limit)


def camel_hits(nodes: DataFrame, wanted: list[str], query: str, limit: int) -> DataFrame:
    """(id, score) of nodes outside tests with a title-cased symbol as a later hump of the name; several humps count more."""
    heads = list(dict.fromkeys(title_case(s) for s in wanted if len(s) >= 3))
    if not heads:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    name = F.col("name")
    each = [F.when(name.rlike("[A-Za-z]" + h.replace("$", "\\$").replace(".", "\\.")), 8.0 + brevity(name, h, 6.0, 4.0) + path_relevance(F.col("file_path"), query)) for h in heads]
    n = _sum([F.when(x.isNotNull(), 1).otherwise(0) for x in each])
    best = F.greatest(*each, F.lit(None).cast("double")) if len(each) > 1 else each[0]
    found = nodes.where(~is_test(F.col("file_path"))).select("id", n.alias("n"), best.alias("best")).where("n > 0")
    return found.select("id", (F.col("best") * (1 + F.col("n")) + 30.0 * (F.col("n") - 1)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def compound_hits(nodes: DataFrame, wanted: list[str], query: str, limit: int) -> DataFrame:
    """(id, score) of nodes whose names contain two symbols or more."""
    if len(wanted) < 2:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    n = _sum([matches(F.col("name"), s).cast("int") for s in dict.fromkeys(wanted)])
    score = 10.0 + 20.0 * (F.col("n") - 1) + path_relevance(F.col("file_path"), query) + F.greatest(F.lit(0.0), 6.0 - F.length("name") / 8.0)
    return nodes.withColumn("n", n).where("n >= 2").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(-(-limit // 2))


def term_groups(wanted: list[str]) -> list[list[str]]:
    """Terms in groups, longest first; a term that stands within one of a group joins it."""
    groups: list[list[str]] = []
    for t in sorted(dict.fromkeys(wanted), key=lambda t: (-len(t), t)):
        home = next((g for g in groups if any(t in x or x in t for x in g)), None)
        if home is None:
            groups.append([t])
        else:
            home.append(t)
    return groups


def co_occurrence(score: Column, name: Column, path: Column, wanted: list[str], distinctive: list[str]) -> Column:
    """A score raised where several groups of terms meet in a name or its directories, and lowered where but one does."""
    if len(wanted) < 2:
        return score
    dirs = F.split(F.lower(directory_of(path)), "/")
    hit = [_any([F.lower(name).contains(t) | F.array_contains(dirs, t) for t in g]).cast("int") for g in term_groups(wanted)]
    n = _sum(hit)
    kept = name.isin(distinctive) if distinctive else F.lit(False)
    return F.when(n >= 2, score * (1 + 0.5 * n)).when(kept, score).otherwise(score * F.when(score >= 70, 0.3).otherwise(0.6))


def find(g: PropertyGraph, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(id, score): the best hits of all channels. Blank queries find nothing; without a symbol, plain search scores 1."""
    nodes = g.nodes.select("id", "kind", "name", "qualified_name", "file_path", "docstring")
    empty = nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    if not query or not query.strip():
        return empty
    wanted, words = symbols(query), terms(query)
    if not wanted:
        from tessera.operators.lookup import search

        return search(nodes, query.strip(), limit=limit).select("id", F.lit(1.0).alias("score"))
    first = exact_hits(nodes, wanted, limit).withColumn("c", F.lit(0)).unionByName(prefix_hits(nodes, wanted, limit).withColumn("c", F.lit(1))).unionByName(term_hits(nodes, words, limit).withColumn("c", F.lit(2)))
    # the channel that comes first has the say; a few dozen rows by now
    first = first_channel(first)
    scored = first.join(nodes.select("id", "name", "file_path"), "id")
    scored = scored.withColumn("score", penalized(F.col("score"), F.col("file_path"), query))
    scored = scored.select("id", co_occurrence(F.col("score"), F.col("name"), F.col("file_path"), words, [s for s in wanted if is_distinctive(s)]).alias("score"))
    more = camel_hits(nodes, wanted, query, limit).unionByName(compound_hits(nodes, wanted, query, limit))
    every = scored.unionByName(more).groupBy("id").agg(F.max("score").alias("score"))
    return finalized(every, limit)


def expand(g: PropertyGraph, roots: DataFrame, most: int = 100, depth: int = DEPTH) -> DataFrame:
    """(id, level) of what surrounds the roots (id): all of them at once, either way over relevant kinds; the nearest first, then by id."""
    e = g.steady_edges(RELEVANT_KINDS)
    return levels(oriented(e, "both"), roots, depth, enough=most).orderBy("level", "id").limit(most)


def relevant(g: PropertyGraph, query: str, limit: int = SEARCH_LIMIT, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Roots (id, score) for a query and the nodes (id, level) around them."""
    roots = cut(find(g, query, limit))
    return roots, expand(g, roots, most)
