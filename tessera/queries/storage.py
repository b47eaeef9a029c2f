"""Queries of the store, sync and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import lookup as L
from tessera.operators import textindex
from tessera.plans import lineage
from tessera.plans.graph import PropertyGraph
from tessera.queries.base import query, table_query
from tessera.sources import store
from tessera.streaming import sync, watch


def _snapshots(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    n = g.nodes.where("kind = 'class'")
    old = n.where("start_line % 7 <> 0").select(F.col("id").alias("path"), F.sha2("name", 256).alias("content_hash"), F.length("name").cast("long").alias("size"), F.col("start_line").cast("long").alias("modified_at"))
    new = n.where("start_line % 5 <> 0").select(F.col("id").alias("path"), F.sha2(F.when(F.expr("start_line % 3 = 0"), F.concat("name", F.lit("x"))).otherwise(F.col("name")), 256).alias("content_hash"), F.length("name").cast("long").alias("size"), (F.col("start_line") + F.expr("CAST(start_line % 2 AS INT)")).cast("long").alias("modified_at"))
    return old, new


_CHANGE_SQL = "SELECT id AS path, CASE WHEN start_line % 7 <> 0 AND start_line % 5 = 0 THEN 'removed' WHEN start_line % 7 = 0 THEN 'added' WHEN start_line % 2 = 0 THEN 'unchanged' WHEN start_line % 3 <> 0 THEN 'touched' ELSE 'modified' END AS change FROM nodes WHERE kind = 'class' AND (start_line % 7 <> 0 OR start_line % 5 <> 0)"
query("d1_changes", _CHANGE_SQL)(lambda g: sync.changes(*_snapshots(g)))
query("a24_sync_counters", f"SELECT change, count(*) AS n FROM ({_CHANGE_SQL}) GROUP BY change")(lambda g: sync.counters(sync.changes(*_snapshots(g))))
query("s15_changed_files", "SELECT id AS path FROM nodes WHERE kind = 'class' AND start_line % 5 <> 0 AND (start_line % 7 = 0 OR start_line % 3 = 0)")(lambda g: sync.changed_by_hash(*_snapshots(g)))
query("s15_git_status", "SELECT DISTINCT file_path AS path FROM nodes WHERE ends_with(file_path, '.java')")(lambda g: sync.git_paths(g.nodes.select(F.when(F.col("kind") == "class", F.concat(F.lit("R  old/X.java -> "), "file_path")).otherwise(F.concat(F.lit(" M "), "file_path")).alias("line"))))
query("d1_synced", "SELECT id AS path, CAST(start_line + CAST(start_line % 2 AS INT) AS BIGINT) AS modified_at FROM nodes WHERE kind = 'class' AND start_line % 5 <> 0")(lambda g: sync.synced(*_snapshots(g)).select("path", "modified_at"))
table_query("d3_bursts", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst")(
    lambda spark, d: watch.bursts(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts", "30 minutes")
)
table_query("d4_pending", "SELECT CAST(user_id AS VARCHAR) AS path, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-02 00:00:00'")(
    lambda spark, d: watch.after_sync(watch.pending(spark.createDataFrame([], "path string, first_seen timestamp_ntz, last_seen timestamp_ntz"), spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp_ntz").alias("ts"))), datetime.datetime(2024, 1, 2))
)
table_query("m1_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k")))
query("d2_relevant_events", "SELECT DISTINCT file_path AS path FROM nodes WHERE ends_with(file_path, '.java')")(lambda g: watch.relevant(g.nodes.select(F.col("file_path").alias("path")).unionByName(g.nodes.select(F.concat(F.lit("build/"), "file_path").alias("path")))).distinct())
table_query("d5_waits", "SELECT user_id, least(2000.0 * pow(2.0, (user_id % 9)), 30000.0) / 1000 AS seconds FROM (SELECT DISTINCT user_id FROM events)")(lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().select("user_id", watch.wait_column(F.col("user_id") % 9 + 1).alias("seconds")))


def _fed(spark: SparkSession, d: str) -> DataFrame:
    """Events through a stream that ends when all are taken: what a retried function wrote."""
    out = lineage.fresh_path(spark, "applied")
    source = lineage.fresh_path(spark, "events")
    spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(source)

    def apply(batch: DataFrame, number: int) -> None:
        watch.pending(batch.select("path", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")).limit(0), batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    watch.watch(spark, source, "path string, ts timestamp", apply, lineage.fresh_path(spark, "watch"), once=True).awaitTermination()
    return spark.read.parquet(out).groupBy("path").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


table_query("d2_streamed", "SELECT CAST(user_id AS VARCHAR) AS path, count(*) > 0 AS seen FROM events GROUP BY user_id")(lambda spark, d: _fed(spark, d).select("path", F.col("last_seen").isNotNull().alias("seen")))

# upserts, deletes, commits
query("k1_upsert", "SELECT id, CASE WHEN start_line % 3 = 0 THEN concat(name, '!') ELSE name END AS name FROM nodes WHERE kind = 'class'")(lambda g: store.upserted(g.nodes.where("kind = 'class'").select("id", "name"), g.nodes.where("kind = 'class' AND start_line % 3 = 0").select("id", F.concat("name", F.lit("!")).alias("name"), F.lit(2).alias("seq")).unionByName(g.nodes.where("kind = 'class' AND start_line % 3 = 0").select("id", "name", F.lit(1).alias("seq"))), "id"))
query("k5_deleted_files", "SELECT e.kind, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.file_path <> 'sales/orders/2-HIGH.java' AND b.file_path <> 'sales/orders/2-HIGH.java' GROUP BY e.kind")(lambda g: A.by_kind(store.deleted_files(g.nodes, g.edges, g.nodes.where("file_path = 'sales/orders/2-HIGH.java'").select(F.col("file_path").alias("path")))[1]))
query("k6_without_edges_of", "SELECT kind, count(*) AS n FROM edges WHERE source <> 'supplier:1' AND target <> 'supplier:1' GROUP BY kind")(lambda g: A.by_kind(store.without_edges_of(g.edges, "supplier:1")))
query("k2_appended_edges", "SELECT kind, CAST(count(*) * CASE kind WHEN 'extends' THEN 2 ELSE 1 END AS BIGINT) AS n FROM edges GROUP BY kind")(lambda g: A.by_kind(store.appended_edges(g.edges, g.edges.where("kind = 'extends'").unionByName(g.edges.where("kind = 'calls'").select(F.concat("source", F.lit("?")).alias("source"), "target", "kind", "line")), g.nodes)))
query("k3_file_records", "SELECT file_path AS path, CAST(count(*) FILTER (WHERE kind <> 'method') AS INT) AS node_count FROM nodes GROUP BY file_path")(lambda g: store.upserted(store.file_records(g.nodes.select(F.col("file_path").alias("path")).distinct(), g.nodes), store.file_records(g.nodes.select(F.col("file_path").alias("path")).distinct(), g.nodes.where("kind <> 'method'")), "path"))


def _refs(g: PropertyGraph) -> DataFrame:
    first = g.edges.where("kind = 'extends'").select(F.lit(0).cast("long").alias("id"), F.col("source").alias("from_node_id"), F.col("target").alias("reference_name"))
    more = g.edges.where("kind = 'implements'").select(F.lit(0).cast("long").alias("id"), F.col("source").alias("from_node_id"), F.col("target").alias("reference_name"))
    return store.appended_refs(store.appended_refs(store.emptied(first), first, ["from_node_id", "reference_name"]), more, ["from_node_id", "reference_name"])


_REFS_SQL = ", refs AS (SELECT row_number() OVER (ORDER BY kind <> 'extends', source, target) AS id, source AS from_node_id, target AS reference_name FROM edges WHERE kind IN ('extends', 'implements'))"
query("k4_appended_refs", f"{_REFS_SQL} SELECT id, from_node_id, reference_name FROM refs")(_refs)
query("k7_emptied_refs", "SELECT count(*) AS n FROM nodes WHERE false")(lambda g: store.emptied(_refs(g)).agg(F.count(F.lit(1)).alias("n")))
query("a3_ref_count", f"{_REFS_SQL} SELECT count(*) AS n FROM refs")(lambda g: _refs(g).agg(F.count(F.lit(1)).alias("n")))
query("s8_refs_page", f"{_REFS_SQL} SELECT id, from_node_id FROM refs ORDER BY id LIMIT 25 OFFSET 100")(lambda g: L.page(_refs(g), 100, 25).select("id", "from_node_id"))


def _stored(g: PropertyGraph) -> store.Store:
    """A store with the graph in one commit, after a first of empty tables and one that fails."""
    spark = g.nodes.sparkSession
    s = store.Store(spark, lineage.fresh_path(spark, "store"))
    s.init()
    base = s.number()
    with s.lock():
        s.commit({"nodes": g.nodes, "edges": g.edges})
    try:
        s.commit({"nodes": store.emptied(g.nodes)}, base)
    except store.Conflict:
        return s
    raise RuntimeError("a commit onto an old one went through")


query("s17_stored", "SELECT kind, count(*) AS n FROM edges GROUP BY kind")(lambda g: A.by_kind(_stored(g).table("edges")))
query("k8_schema", "SELECT 'files' AS name, 0::BIGINT AS n UNION ALL SELECT 'refs', 0")(lambda g: (lambda s: s.table("files").agg(F.lit("files").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(s.table("refs").agg(F.lit("refs").alias("name"), F.count(F.lit(1)).alias("n"))))(_stored(g)))
query("k9_committed", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")(lambda g: A.by_kind(_stored(g).table("nodes")))
query("a25_schema_version", "SELECT 1 AS version")(lambda g: store.schema_version(_stored(g).table("schema_versions")))
query("k10_index", """, t AS (SELECT id, list_filter(string_split_regex(lower(concat_ws(' ', CASE WHEN kind = 'class' THEN concat(name, ' anew') ELSE name END, qualified_name, docstring)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM nodes WHERE kind <> 'interface')
 SELECT token, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(w) AS token FROM t) GROUP BY id, token) GROUP BY token""")(lambda g: textindex.refreshed(textindex.build(g.nodes), g.nodes.where("kind = 'class'").withColumn("name", F.concat("name", F.lit(" anew"))), g.nodes.where("kind = 'interface'").select("id")).groupBy("token").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("n")))
query("k10_matching", "SELECT id FROM nodes WHERE list_has_all(string_split_regex(lower(concat_ws(' ', name, qualified_name, docstring)), '[^\\p{L}\\p{N}]+'), ['red', 'ring'])")(lambda g: textindex.matching(textindex.build(g.nodes), ["Red", "ring"]).select("id"))
