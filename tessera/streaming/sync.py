"""Incremental sync: what changed between a tracked snapshot and the current one, and the index that follows it."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.fixpoint import union_all
from tessera.plans.lineage import cut
from tessera.sources import files as sources
from tessera.sources import frameworks, java
from tessera.sources.store import SCHEMA_VERSION, SCHEMAS, Conflict, Store, deleted_files, file_records


def changes(tracked: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """(path, change) of files (path, content_hash, size, modified_at) on either side.

    removed and added by which side has it; unchanged if size and time agree; touched if
    only the hash does; else modified. Forced, all that is there is added or modified.
    """
    t = tracked.select("path", F.col("content_hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("modified_at").alias("old_at"), F.lit(True).alias("was"))
    c = current.select("path", "content_hash", "size", "modified_at", F.lit(True).alias("now"))
    same = (F.col("size") == F.col("old_size")) & (F.col("modified_at") == F.col("old_at"))
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.lit(force), "modified").when(same, "unchanged").when(F.col("content_hash") == F.col("old_hash"), "touched").otherwise("modified")
    return t.join(c, "path", "full_outer").select("path", change.alias("change"))


def changed_by_hash(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """(path) of current files that aren't tracked or whose hash is another."""
    same = tracked.select("path", "content_hash")
    return current.select("path", "content_hash").join(same, ["path", "content_hash"], "left_anti").select("path")


def git_paths(status: DataFrame) -> DataFrame:
    """(path) of source files in lines (line) of a short git status: what stands after the two marks, and of a rename the new name."""
    path = F.regexp_replace(F.substring_index(F.expr("substring(line, 4)"), " -> ", -1), '^"|"$', "")
    return sources.code_files(status.where(F.length("line") >= 4).select(path.alias("path")).distinct())


def changed_files(spark: SparkSession, root: str, tracked: DataFrame) -> DataFrame:
    """(path) of files that changed since they were tracked: what git says where root is a work tree, else by their hashes."""
    local = root.removeprefix("file://")
    try:
        done = subprocess.run(["git", "-C", local, "status", "--porcelain", "--untracked-files=all"], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        done = None
    if done is not None and done.returncode == 0:
        return git_paths(spark.createDataFrame([(x,) for x in done.stdout.splitlines()], "line string"))
    return changed_by_hash(tracked, sources.source_files(spark, root, with_content=False))


def counters(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def synced(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """The snapshot to track from now on: the current one, without what was removed."""
    return current.select(*tracked.columns)


class Result(NamedTuple):
    """What a sync did."""

    files_checked: int
    files_added: int
    files_modified: int
    files_removed: int
    nodes_updated: int
    edges: int
    commit: int

    @property
    def files_changed(self) -> int:
        return self.files_added + self.files_modified + self.files_removed


_NODE = java.NODE
_REF = "ref_id string, from_node_id string, reference_name string, reference_kind string, receiver string, line int, file_path string"
_TABLES = {"nodes": _NODE, "structure": "source string, target string, kind string, line int", "edges": "source string, target string, kind string, line int, provenance string", "files": "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, errors string", "refs": _REF, "schema_versions": SCHEMAS["schema_versions"]}


def init(spark: SparkSession, path: str) -> Store:
    """The store at path, made if it isn't there, with an index's tables."""
    store = Store(spark, path)
    if not store.exists():
        tables = {name: spark.createDataFrame([], schema) for name, schema in _TABLES.items()}
        tables["schema_versions"] = spark.createDataFrame([(SCHEMA_VERSION, int(time.time() * 1000), "first schema")], _TABLES["schema_versions"])
        store.commit(tables)
    return store


def sync(store: Store, root: str, force: bool = False, progress: Callable[[str], None] = lambda step: None) -> Result:
    """Bring the index in store up to the files under root, under the store's lock and in one commit.

    Files that are gone lose their nodes; those added or modified are read anew, each on
    its own, so that one that can't be read keeps its error and holds up no other.
    References of all files stay in a table and are resolved together, so that an
    unchanged file's edge to a symbol comes back when that symbol is made again.
    Running it again without a change leaves all as it is.
    """
    spark = store.spark
    with store.lock():
        base = store.number()
        old = {name: store.table(name, base) for name in _TABLES}
        progress("scan")
        every = cut(sources.wanted(sources.listed(spark, root)))
        current = cut(sources.described(sources.code_files(every)))
        changed = cut(changes(old["files"], current, force))
        n = {r.change: r.n for r in counters(changed).collect()}
        checked = sum(k for c, k in n.items() if c != "removed")
        if not (n.get("added") or n.get("modified") or n.get("removed")):
            if n.get("touched"):  # their times alone moved
                kept = old["files"].drop("modified_at").join(current.select("path", "modified_at"), "path").select(*old["files"].columns)
                base = store.commit({"files": kept}, base)
            return Result(checked, 0, 0, 0, 0, old["edges"].count(), base)
        progress("extract")
        fresh = changed.where("change IN ('added', 'modified')").select("path")
        extracts = cut(java.extracted(current.join(fresh, "path", "left_semi")))
        made, structure, refs = java.merged(extracts)
        gone = changed.where("change IN ('removed', 'modified')").select("path")
        kept_nodes, kept_structure = deleted_files(old["nodes"].where("kind <> 'route' AND NOT (kind = 'constant' AND qualified_name LIKE 'config:%')"), old["structure"], gone)
        nodes = cut(kept_nodes.unionByName(made.dropDuplicates(["id"]).select(*kept_nodes.columns)))
        structure = cut(kept_structure.unionByName(structure.select(*kept_structure.columns)))
        refs = cut(old["refs"].join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*old["refs"].columns).unionByName(refs.select(*old["refs"].columns)))
        progress("frameworks")
        texts = current.select("path", "text")
        which = frameworks.detected(texts.unionByName(sources.build_files(every).select("path", F.col("content").cast("string").alias("text"))))
        declared, uses = frameworks.extracted(texts, nodes, which)
        nodes = cut(nodes.unionByName(declared.select(*nodes.columns)).dropDuplicates(["id"])) if declared is not None else nodes
        progress("resolve")
        conventions = frameworks.by_convention(refs, nodes) if "spring" in which else None
        found = java.resolved_edges(nodes, structure, refs, conventions).withColumn("provenance", F.lit("resolution"))
        parts = [structure.withColumn("provenance", F.lit("extraction")), found] + ([uses.select(*found.columns)] if uses is not None else [])
        from tessera.operators.joins import sound_edges

        edges = cut(sound_edges(union_all(parts), nodes).select(*old["edges"].columns))
        progress("commit")
        at = int(time.time() * 1000)
        before = old["files"].select("path", "indexed_at", F.col("errors").alias("old_errors"))
        records = current.join(extracts.select("path", F.col("errors").alias("new_errors"), F.lit(True).alias("read")), "path", "left").join(before, "path", "left")
        records = records.select("path", "content_hash", "language", "size", "modified_at", F.when(F.col("read"), F.lit(at)).otherwise(F.col("indexed_at")).alias("indexed_at"), F.when(F.col("read"), F.col("new_errors")).otherwise(F.col("old_errors")).alias("errors"))
        files = file_records(records, nodes).select(*old["files"].columns)
        updated = made.select("id").distinct().count() + (declared.count() if declared is not None else 0)
        number = store.commit({"nodes": nodes, "structure": structure, "edges": edges, "files": files, "refs": refs}, base)
        return Result(checked, n.get("added", 0), n.get("modified", 0), n.get("removed", 0), updated, edges.count(), number)


__all__ = ["Conflict", "Result", "changed_by_hash", "changed_files", "changes", "counters", "git_paths", "init", "sync", "synced"]
