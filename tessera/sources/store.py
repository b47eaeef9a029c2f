"""Tables of the graph kept as Parquet: upserts, deletes with cascade, and batches that come whole or not at all."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.fixpoint import first_of
from tessera.plans.lineage import cut
from tessera.plans.schema import EDGE_SCHEMA, FILE_SCHEMA, NODE_SCHEMA, REF_SCHEMA

#: The version of the schemas, and the tables that a new store has.
SCHEMA_VERSION = 1
SCHEMAS = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA, "files": FILE_SCHEMA, "refs": REF_SCHEMA, "schema_versions": "version int NOT NULL, applied_at bigint NOT NULL, description string"}
#: Seconds after which a writer's lock counts as left behind.
LOCK_SECONDS = 3_600


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new in place of those of the same key; of several new rows of a key the last by seq, if there is one."""
    latest = first_of(new, [key], [F.desc("seq")]).drop("seq") if "seq" in new.columns else new.dropDuplicates([key])
    return old.join(latest.select(key), key, "left_anti").unionByName(latest.select(*old.columns))


def appended_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges and those of new that don't dangle; an edge that is there already comes again, as edges have no key."""
    from tessera.operators.joins import sound_edges

    return edges.unionByName(sound_edges(new, nodes).select(*edges.columns))


def file_records(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files (path, ...) with node_count: how many nodes each has."""
    n = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("node_count"))
    return files.drop("node_count").join(n, "path", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))


def appended_refs(refs: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """refs (id, ...) and new ones with the next ids, in the order of these columns.

    Rows are numbered within ranges of the order, and ranges follow each other, so no task holds all.
    """
    last = refs.agg(F.max("id")).first()[0] or 0
    w = Window.partitionBy("__p").orderBy(*order)
    placed = cut(new.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.row_number().over(w)))
    # as many rows as there are ranges
    sizes = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}
    starts = [x for p in sorted(sizes) for x in (F.lit(p), F.lit(last + sum(n for q, n in sizes.items() if q < p)))]
    if not starts:
        return refs
    return refs.unionByName(placed.withColumn("id", (F.create_map(*starts)[F.col("__p")] + F.col("__k")).cast("long")).select(*refs.columns))


def emptied(table: DataFrame) -> DataFrame:
    """The table without its rows."""
    return table.where(F.lit(False))


def deleted_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of files (path), and without edges an end of which isn't among the nodes that stay."""
    from tessera.operators.joins import sound_edges

    gone = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti")
    return kept, sound_edges(edges, kept).select(*edges.columns)


def without_edges_of(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("source") != node_id) & (F.col("target") != node_id))


class Conflict(RuntimeError):
    """Another writer committed first, or holds the lock."""


class Store:
    """A folder of versions. Each commit writes tables under a name of their own, then a list of all tables under the next number, which only one writer can create; readers take the highest."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _create(self, name: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is."""
        at, tmp = self._path(name), self._path(f"_tmp/{uuid.uuid4().hex}")
        if self._fs.exists(at):
            return False
        out = self._fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(at.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:  # without overwriting: of two writers one fails here
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, at, options)
        except Exception as e:  # noqa: BLE001  py4j wraps whatever the file system throws
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(tmp, False)
            return False
        return True

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def number(self) -> int:
        """The number of the last commit, 0 before the first."""
        at = self._path("versions")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0

    def version(self, number: int | None = None) -> dict[str, str] | None:
        """The tables of a commit, by default the last one, and where each lies."""
        n = self.number() if number is None else number
        return json.loads(self._read(f"versions/{n:012d}")) if n else None

    def exists(self) -> bool:
        return self.number() > 0

    def init(self) -> None:
        """Empty tables and the first row of schema_versions, unless there is a store already."""
        if self.exists():
            return
        tables = {name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        tables["schema_versions"] = self.spark.createDataFrame([(SCHEMA_VERSION, int(time.time() * 1000), "first schema")], SCHEMAS["schema_versions"])
        self.commit(tables)

    def schema_version(self) -> int | None:
        """The highest version in schema_versions; None without a store."""
        return schema_version(self.table("schema_versions")).first().version if self.exists() and "schema_versions" in self.version() else None

    def commit(self, tables: dict[str, DataFrame], onto: int | None = None) -> int:
        """Write tables together: readers see all or none of them, and those that aren't given stay. onto: the commit that they were made from; a Conflict if there is a later one."""
        base = self.number() if onto is None else onto
        name = uuid.uuid4().hex
        try:
            for table, df in tables.items():
                df.write.parquet(f"{self.path}/{table}/{name}")
            known = (self.version(base) or {}) | {table: name for table in tables}
            if not self._create(f"versions/{base + 1:012d}", json.dumps(known, sort_keys=True)):
                raise Conflict(f"commit {base + 1} is there already")
        except BaseException:
            for table in tables:
                self._fs.delete(self._path(f"{table}/{name}"), True)
            raise
        return base + 1

    def table(self, name: str, number: int | None = None) -> DataFrame:
        known = self.version(number) or {}
        if name not in known:
            raise KeyError(f"no table {name!r} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{name}/{known[name]}")

    def lock(self) -> Lock:
        return Lock(self)


class Lock:
    """One writer at a time: a file that only one can create. One that is left behind by a writer that died counts for LOCK_SECONDS."""

    def __init__(self, store: Store) -> None:
        self.store, self.text = store, json.dumps({"id": uuid.uuid4().hex, "at": time.time()})

    def __enter__(self) -> Lock:
        s = self.store
        if not s._create("lock", self.text):
            held = json.loads(s._read("lock"))
            if time.time() - held["at"] < LOCK_SECONDS:
                raise Conflict("another writer holds the lock")
            s._fs.delete(s._path("lock"), False)
            if not s._create("lock", self.text):
                raise Conflict("another writer holds the lock")
        return self

    def __exit__(self, *_) -> None:
        s = self.store
        if s._fs.exists(s._path("lock")) and s._read("lock") == self.text:
            s._fs.delete(s._path("lock"), False)


def schema_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max("version").alias("version"))
