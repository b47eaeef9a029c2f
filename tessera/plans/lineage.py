"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package even where the driver's folders are not theirs."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{root.name}_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where there is one machine alone, one of our own if it is unset."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='tessera_')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}_{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder, which executors share, and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are over, which it does when the driver's garbage is collected."""
    for _ in range(2):  # what Python lets go of is garbage to the driver's JVM a moment later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
