"""Streams of file events: bursts end after a silence, a batch is taken up again after an error, and takes effect once."""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicates import is_kept, is_source
from tessera.sources.files import relative

#: Milliseconds of silence that end a burst, retries, the longest wait, and how long a first call waits for the first sync.
SILENCE_MS, RETRIES, LONGEST_MS, GATE_SECONDS = 2_000, 5, 30_000, 30
#: Environment settings that turn watching off, or on whatever else says.
NO_WATCH, FORCE_WATCH = "TESSERA_NO_WATCH", "TESSERA_FORCE_WATCH"


def bursts(events: DataFrame, key: str = "path", at: str = "ts", silence: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, first, last, n) of each burst of events of a key; batch or streaming. An event over late behind the newest is left out of a stream."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(at, silence).alias("w"), key)
    return g.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).select(key, "first", "last", "n")


def relevant(events: DataFrame, path: str = "path") -> DataFrame:
    """Events at source files that aren't excluded."""
    return events.where(is_source(F.col(path)) & is_kept(F.col(path)))


def pending(state: DataFrame, events: DataFrame) -> DataFrame:
    """(path, first_seen, last_seen) after more events (path, ts)."""
    e = events.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return state.unionByName(e).groupBy("path").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def after_sync(state: DataFrame, started) -> DataFrame:
    """What stays pending after a sync that began then: files seen later."""
    return state.where(F.col("last_seen") > F.lit(started))


def waits(failures: int, silence_ms: int = SILENCE_MS) -> float:
    """Seconds until the next try after so many failures."""
    return min(silence_ms * 2 ** (failures - 1), LONGEST_MS) / 1000


def wait_column(failures: Column, silence_ms: int = SILENCE_MS) -> Column:
    """waits() of a column."""
    return F.least(F.lit(float(silence_ms)) * F.pow(F.lit(2.0), failures - 1), F.lit(float(LONGEST_MS))) / 1000


class Retrying:
    """A foreachBatch function that is tried again on transient errors; each batch takes effect once, by its number.

    done reads and writes the number of the last batch that took effect. It should be
    kept where the effect is, as by StoredNumber; in memory alone, a batch that a restart
    brings again takes effect again.
    """

    def __init__(self, apply: Callable[[DataFrame, int], None], transient: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep, done: StoredNumber | None = None) -> None:
        self.apply, self.transient, self.sleep, self.stored, self.done, self.degraded = apply, transient, sleep, done, -1, False

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.stored is not None:
            self.done = max(self.done, self.stored.read())
        if number <= self.done:
            return
        for failures in range(RETRIES + 1):
            try:
                self.apply(batch, number)
            except self.transient:
                if failures == RETRIES:
                    self.degraded = True
                    raise
                self.sleep(waits(failures + 1))
                continue
            self.done = number
            if self.stored is not None:
                self.stored.write(number)
            return


class StoredNumber:
    """The number of the last batch that took effect, as a file for each in a folder of any file system that Spark reaches; it outlives the driver."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self) -> int:
        at = self._path("")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(at)), default=-1) if self._fs.exists(at) else -1

    def write(self, number: int) -> None:
        self._fs.create(self._path(f"{number:012d}"), True).close()
        for f in self._fs.listStatus(self._path("")):
            if int(f.getPath().getName()) < number:
                self._fs.delete(f.getPath(), False)


def watch(spark: SparkSession, root: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Follow a folder of event files and apply each micro-batch; once: take what is there and end."""
    stream = spark.readStream.schema(schema).parquet(root)
    w = stream.writeStream.foreachBatch(Retrying(apply, done=StoredNumber(spark, f"{checkpoint}/applied"))).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{SILENCE_MS} milliseconds")).start()


def file_events(spark: SparkSession, root: str, most_files: int | None = None) -> DataFrame:
    """A stream of (path, ts, size) of source files that appear or change under root, by their modification times; excluded ones stay out."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    raw = (r.option("maxFilesPerTrigger", most_files) if most_files else r).load(root)
    e = raw.select(relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("ts"), F.col("length").alias("size"))
    return relevant(e)


class Gate:
    """Lets calls through once a first sync, begun in the background, has ended, or after GATE_SECONDS; a sync that failed lets them through as well, and its error is kept."""

    def __init__(self, work: Callable[[], object], seconds: float = GATE_SECONDS) -> None:
        self.error: BaseException | None = None
        self.seconds, self._done = seconds, threading.Event()

        def run() -> None:
            try:
                work()
            except BaseException as e:  # noqa: BLE001  it is told to whoever asks
                self.error = e
            finally:
                self._done.set()

        threading.Thread(target=run, daemon=True).start()

    def wait(self) -> bool:
        """Whether the sync has ended."""
        return self._done.wait(self.seconds)


def disabled_reason(root: str, environment: Mapping[str, str] | None = None) -> str | None:
    """Why root isn't to be watched; None if it may be."""
    env = os.environ if environment is None else environment
    if env.get(NO_WATCH) == "1":
        return f"{NO_WATCH}=1 is set"
    if env.get(FORCE_WATCH) == "1":
        return None
    if ("WSL_DISTRO_NAME" in env or "WSL_INTEROP" in env) and re.match(r"(?i)^/mnt/[a-z](/|$)", str(Path(root)).replace("\\", "/")):
        return "the project lies on a mounted Windows drive, which is too slow to be watched"
    return None
