"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a batch that a Python function works on at a time.
SLICE_BYTES = 2 << 20
#: Entries a worker's word caches hold before they start afresh; bounds memory, never results.
CACHE_ENTRIES = 200_000

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
        d = f"file://{tempfile.mkdtemp(prefix='tessera_shared_')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}_{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Nodes of a physical plan that give the same rows in the same partitions whenever they run.
_STEADY = {"FileSourceScanExec", "BatchScanExec", "ProjectExec", "FilterExec", "ColumnarToRowExec", "WholeStageCodegenExec", "InputAdapter"}


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads files, filters and projects, so that reading it twice gives the same partitions in the same order."""

    def steady(node) -> bool:
        children = node.children()
        return node.getClass().getSimpleName() in _STEADY and all(steady(children.apply(i)) for i in range(children.size()))

    return steady(df._jdf.queryExecution().executedPlan())


def steady(df: DataFrame, what: str) -> DataFrame:
    """df if it is a scan, else what it gives, written to the shared folder and read from there."""
    if is_scan(df):
        return df
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with a larger share of all rows than one in so many is hot, if it has some rows at all; there are at most so many of them.
HOT_KEYS, HOT_LEAST = 4_096, 1_000


def join_unique(rows: DataFrame, found: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """rows, left-joined with found by keys, of which found has each once, with the number of its rows in copies.

    What is found for hot keys, at most HOT_KEYS of them, is broadcast, so that their rows
    stay where they are; the others meet in an exchange, where no key is large.
    """
    least = max(HOT_LEAST, total // HOT_KEYS)
    hot = found.where(F.col(copies) > least).drop(copies)
    if total <= least or hot.isEmpty():
        return rows.join(found.drop(copies), keys, "left")
    cold = found.where(F.col(copies) <= least).drop(copies)
    here = rows.join(F.broadcast(hot), keys)
    there = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return here.unionByName(there.select(*here.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and U+0009 to U+000D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """64-bit hash of a word's bytes (of a string, its UTF-8), remembered up to CACHE_ENTRIES words."""

    def __missing__(self, word: bytes | str) -> int:
        h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h
        return h


WORD_HASH = WordHash()


def word_hashes(ws: list[bytes] | list[str]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers for the places of a window, made by a fixed rule.
PLACES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words; fewer words count as one window, none as no window."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * PLACES[j]
    return mix(out)


def fold(doc_id: int | None, n: int = 5) -> int:
    """crc32 of the id as decimal text, modulo n; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold_col(doc_id: str = "doc_id", n: int = 5) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes; a larger row comes alone."""
    for rb in batches:
        n = rb.num_rows
        step = max(1, n * size // max(1, rb.nbytes))
        if step >= n:
            yield rb
            continue
        for a in range(0, n, step):
            part = rb.slice(a, step)
            yield from slices([part], size) if part.num_rows > 1 and part.nbytes > 4 * size else [part]


def release() -> None:
    """Give memory that a task, or a step on the driver, no longer needs back to the system: a worker that waits for its next task keeps none."""
    WORD_HASH.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of bounded bytes, by workers that are small again when a task ends."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from f(slices(batches))
        finally:
            release()

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def texts(rb: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null ones as empty."""
    return [x or "" for x in rb.column(name).to_pylist()]


def put_in_place(fs: pafs.FileSystem, tmp: str, final: str) -> None:
    """Give a file that is whole its final name; another attempt of the same task may have done so before, with the same bytes."""
    try:
        fs.move(tmp, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(tmp)
