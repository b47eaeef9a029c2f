"""Resolution of symbolic references to nodes, set-wise: every reference at once, by joins.

Imports come first, then names at three levels. Of the candidates of a name the nearest
one is kept for each file, directory and leading directory that has some, before
references meet them; so a reference meets a few rows, however many nodes bear its name.

Both sides of these joins grow with the sources. Joins are merges by hint, as rows that
compress well would be broadcast by the size of their shuffled bytes, and fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import directory_of
from tessera.operators.analytics import EXPORTED, LEADING, SAME_DIRECTORY, SAME_FILE, STEP
from tessera.plans.fixpoint import first_of
from tessera.plans.lineage import cut


def by_import(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target) of refs (ref_id, reference_name, file_path) by imports of the same file: by the import's last part, or by a wildcard's prefix and the name."""
    imports = nodes.where("kind = 'import'").select("file_path", F.col("qualified_name").alias("path"))
    single = imports.where(~F.col("path").endswith(".*")).select("file_path", F.substring_index("path", ".", -1).alias("reference_name"), "path", F.lit(0).alias("rank"))
    wild = imports.where(F.col("path").endswith(".*")).select("file_path", F.expr("substring(path, 1, length(path) - 1)").alias("prefix"))
    # references with one name in one file have one answer
    asked = refs.select("file_path", "reference_name").distinct()
    named = asked.join(single.hint("merge"), ["file_path", "reference_name"]).select("file_path", "reference_name", "path", "rank")
    spread = asked.join(wild.hint("merge"), "file_path").select("file_path", "reference_name", F.concat("prefix", "reference_name").alias("path"), F.lit(1).alias("rank"))
    targets = nodes.where("kind NOT IN ('import', 'module')").groupBy(F.col("qualified_name").alias("path")).agg(F.min("id").alias("target"))
    best = named.unionByName(spread).join(targets.hint("merge"), "path").groupBy("file_path", "reference_name").agg(F.min(F.struct("rank", "target")).alias("x")).select("file_path", "reference_name", F.col("x.target").alias("target"))
    return refs.join(best.hint("merge"), ["file_path", "reference_name"]).select("ref_id", "target")


def _places(path: Column) -> Column:
    """Where a file stands, as (scope, place, bonus): itself, its directory, each leading directory up to LEADING, and anywhere."""
    d = directory_of(path)
    depth = F.when(d == "", 0).otherwise(F.size(F.split(d, "/")))
    shared = STEP * F.least(depth, F.lit(LEADING))
    leading = F.when(d == "", F.array().cast("array<struct<scope:string,place:string,bonus:int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(depth, F.lit(LEADING)))), lambda k: F.struct(F.concat(F.lit("p"), k.cast("string")).alias("scope"), F.array_join(F.slice(F.split(d, "/"), 1, k), "/").alias("place"), (STEP * k).cast("int").alias("bonus"))))
    own = F.array(F.struct(F.lit("f").alias("scope"), path.alias("place"), (SAME_FILE + SAME_DIRECTORY + shared).cast("int").alias("bonus")), F.struct(F.lit("d").alias("scope"), d.alias("place"), (SAME_DIRECTORY + shared).cast("int").alias("bonus")), F.struct(F.lit("").alias("scope"), F.lit("").alias("place"), F.lit(0).alias("bonus")))
    return F.concat(own, leading)


def by_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, level) by qualified name, else name, else lower-cased name; of several the nearest by path, then the least id."""
    n = nodes.where("kind NOT IN ('import', 'module')").select(F.col("id").alias("target"), "name", "qualified_name", F.col("file_path").alias("target_path"), "is_exported")
    keys = n.select("target", "target_path", "is_exported", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("qualified_name").alias("key")), F.struct(F.lit(1).alias("level"), F.col("name").alias("key")), F.struct(F.lit(2).alias("level"), F.lower("name").alias("key")))).alias("k")).select("target", "target_path", "is_exported", "k.level", "k.key")
    offers = keys.select("level", "key", "target", "is_exported", F.explode(_places(F.col("target_path"))).alias("p")).groupBy("level", "key", F.col("p.scope").alias("scope"), F.col("p.place").alias("place")).agg(F.min(F.struct((~F.col("is_exported")).cast("int").alias("hidden"), "target")).alias("x"))
    asked = refs.select("reference_name", "file_path").distinct()
    sought = asked.select("*", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("reference_name").alias("key")), F.struct(F.lit(1).alias("level"), F.col("reference_name").alias("key")), F.struct(F.lit(2).alias("level"), F.lower("reference_name").alias("key")))).alias("k")).select("reference_name", "file_path", "k.level", "k.key", F.explode(_places(F.col("file_path"))).alias("p")).select("reference_name", "file_path", "level", "key", "p.scope", "p.place", "p.bonus")
    near = sought.join(offers.hint("merge"), ["level", "key", "scope", "place"]).select("reference_name", "file_path", "level", (F.col("bonus") + EXPORTED * (1 - F.col("x.hidden"))).alias("near"), F.col("x.target").alias("target"))
    best = best_candidate(near, ["reference_name", "file_path"]).select("reference_name", "file_path", "target", "level")
    return refs.join(best.hint("merge"), ["reference_name", "file_path"]).select("ref_id", "target", "level")


def best_candidate(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of each group's candidates (level, near, target) the one of the least level, then the nearest, then the least target: a partial aggregate, so a group isn't gathered."""
    x = candidates.groupBy(*by).agg(F.min(F.struct("level", (-F.col("near")).alias("far"), "target")).alias("x"))
    return x.select(*by, F.col("x.target").alias("target"), F.col("x.level").alias("level"), (-F.col("x.far")).alias("near"))


def resolved(refs: DataFrame, nodes: DataFrame, framework: DataFrame | None = None) -> DataFrame:
    """refs (ref_id, from_node_id, reference_name, reference_kind, line, file_path) with target and how it was found; both null where nothing fits.

    framework (ref_id, target) has what frameworks' conventions say, which comes first; then imports, then names.
    """
    # each way is written before they meet, so its plan isn't held with the other's
    i = cut(by_import(refs, nodes).withColumnRenamed("target", "imported"))
    n = cut(by_name(refs, nodes).select("ref_id", F.col("target").alias("named")))
    both = refs.join(i.hint("merge"), "ref_id", "left").join(n.hint("merge"), "ref_id", "left")
    both = both.join(framework.select("ref_id", F.col("target").alias("framed")), "ref_id", "left") if framework is not None else both.withColumn("framed", F.lit(None).cast("string"))
    how = F.when(F.col("framed").isNotNull(), "framework").when(F.col("imported").isNotNull(), "import").when(F.col("named").isNotNull(), "name")
    return both.withColumn("target", F.coalesce("framed", "imported", "named")).withColumn("resolved_by", how).drop("framed", "imported", "named")


def as_edges(found: DataFrame) -> DataFrame:
    """Edges of resolved references; a kind that no edge has becomes references."""
    from tessera.plans.schema import EDGE_KINDS

    kind = F.when(F.col("reference_kind").isin(*EDGE_KINDS), F.col("reference_kind")).otherwise("references")
    return found.where("target IS NOT NULL").select(F.col("from_node_id").alias("source"), "target", kind.alias("kind"), "line", F.create_map(F.lit("confidence"), F.lit("0.95"), F.lit("resolvedBy"), F.lit("resolution")).alias("metadata"))


def calls_in_file(refs: DataFrame, methods: DataFrame) -> DataFrame:
    """(ref_id, target) of calls (ref_id, file_path, name, receiver) to methods (id, file_path, name, is_exported, ord) of their own file.

    this and no receiver take the first of the name, another receiver the first exported one, else the first.
    """
    m = methods.select(F.col("id").alias("target"), "file_path", "name", "is_exported", "ord")
    prefers = F.col("receiver").isNotNull() & (F.col("receiver") != "this")
    return first_of(refs.join(m.hint("merge"), ["file_path", "name"]), ["ref_id"], [F.when(prefers & F.col("is_exported"), 0).otherwise(1), "ord", "target"]).select("ref_id", "target")


def super_calls(refs: DataFrame, methods: DataFrame, extends: DataFrame) -> DataFrame:
    """(ref_id, target) of calls by super (ref_id, class_id, name): the method of that name in the class extended."""
    up = extends.select(F.col("source").alias("class_id"), F.col("target").alias("parent"))
    m = methods.select(F.col("id").alias("target"), F.col("class_id").alias("parent"), "name")
    return first_of(refs.join(up, "class_id").join(m, ["parent", "name"]), ["ref_id"], ["target"]).select("ref_id", "target")


def field_references(idents: DataFrame, fields: DataFrame) -> DataFrame:
    """Different (source, target) of identifiers (source, file_path, name) that name fields or enum members of their file."""
    return idents.join(fields.select(F.col("id").alias("target"), "file_path", "name").hint("merge"), ["file_path", "name"]).select("source", "target").distinct()
