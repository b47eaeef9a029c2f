"""The graph that operators work on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import fixtures, lineage
from tessera.plans.schema import EDGE_KINDS, NODE_KINDS


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at path, which is a file or a folder of files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


#: Where graphs are stored, by application, folder and the state of its files.
_STORED: dict[tuple, str] = {}


@dataclass
class PropertyGraph:
    """Nodes (id, kind, name, qualified_name, file_path, ...) and edges (source, target, kind, line, ...)."""

    nodes: DataFrame
    edges: DataFrame
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @classmethod
    def derived(cls, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        """The graph over the relational tables of sf_dir."""
        return cls(fixtures.nodes(spark, sf_dir), fixtures.edges(spark, sf_dir))

    @classmethod
    def kept(cls, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        """The graph over the relational tables of sf_dir, derived and stored once for each state of their files in this application; questions to it read what they need of the stored one."""
        key = (spark.sparkContext.applicationId, sf_dir, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in fixtures.TABLES))
        if key not in _STORED:
            path = lineage.fresh_path(spark, "graph")
            cls.derived(spark, sf_dir).save(path)
            lineage.release(spark)  # else the shuffle files of the derivation stay beside the graph
            _STORED[key] = path
        return cls.stored(spark, _STORED[key])

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> PropertyGraph:
        """The graph that save() wrote."""
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def save(self, path: str) -> None:
        """Nodes and edges as Parquet, edges in a folder for each kind, so that filters on kind prune folders."""
        self.nodes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/edges")

    def steady_edges(self, kinds: tuple[str, ...] = ()) -> DataFrame:
        """Edges of these kinds (all if none are given), written once for loops that join them again and again."""
        key = ",".join(sorted(kinds))
        if key not in self._kept:
            e = self.edges.where(F.col("kind").isin(*kinds)) if kinds else self.edges
            self._kept[key] = lineage.cut(e.select("source", "target", "kind", "line"))
        return self._kept[key]

    def quarantined(self) -> tuple[PropertyGraph, DataFrame]:
        """The graph without edges that dangle or have an unknown kind, and those edges with a reason."""
        ids = self.nodes.select("id")
        bad = self.edges.join(ids.withColumnRenamed("id", "source").withColumn("has_source", F.lit(True)), "source", "left").join(ids.withColumnRenamed("id", "target").withColumn("has_target", F.lit(True)), "target", "left")
        reason = F.when(~F.col("kind").isin(*EDGE_KINDS), "kind").when(F.col("has_source").isNull(), "source").when(F.col("has_target").isNull(), "target")
        tagged = bad.withColumn("reason", reason).drop("has_source", "has_target")
        known = self.nodes.where(F.col("kind").isin(*NODE_KINDS))
        return PropertyGraph(known, tagged.where("reason IS NULL").drop("reason").select(*self.edges.columns)), tagged.where("reason IS NOT NULL")
