"""The command line: init, index, sync, serve."""

from __future__ import annotations

import argparse
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import api
from tessera.plans.graph import PropertyGraph
from tessera.plans.schema import EDGE_KINDS
from tessera.sources import files
from tessera.sources.store import Conflict, Store
from tessera.streaming import git, sync, watch

#: Where a project's index lies.
FOLDER = ".tessera"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="An index of a project's code, and tools that ask it.")
    commands = p.add_subparsers(dest="command", required=True)
    for name, what in (("init", "make an empty index"), ("index", "index all files"), ("sync", "bring the index up to the files"), ("serve", "answer tools' calls")):
        c = commands.add_parser(name, help=what)
        c.add_argument("-p", "--project", default=".", help="the project's folder or address")
        if name == "index":
            c.add_argument("--force", action="store_true", help="read every file anew")
            c.add_argument("--watch", action="store_true", help="go on with changes as they come")
        if name in ("sync", "index"):
            c.add_argument("-q", "--quiet", action="store_true")
        if name == "serve":
            c.add_argument("--mcp", action="store_true", help="answer line by line on the standard streams")
            c.add_argument("--web-port", type=int, help="answer over HTTP as well")
            c.add_argument("--db-path", help="an index elsewhere")
    return p


def located(project: str) -> str:
    """A project's address: as it is if it has a scheme, else as that of a local folder."""
    return project.rstrip("/") if "://" in project else f"file://{Path(project).resolve()}"


def graph(store: Store) -> tuple[PropertyGraph, DataFrame]:
    """The indexed graph, and the paths of its files."""
    return PropertyGraph(store.table("nodes"), store.table("edges").where(F.col("kind").isin(*EDGE_KINDS))), store.table("files")


def engine(spark: SparkSession, root: str, store: Store) -> api.Engine:
    """Tools over a project's index; source is read from its files as they are now."""
    return api.Engine(graph(store)[0], files.source_files(spark, root).select("path", "text"))


def report(r: sync.Result) -> str:
    return f"{r.files_checked} files checked, {r.files_added} added, {r.files_modified} modified, {r.files_removed} removed, {r.nodes_updated} nodes updated, {r.edges} edges"


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, lines=None, write=None) -> int:
    """Run a command; 0 if it went well. lines and write stand in for the standard streams."""
    a = parser().parse_args(arguments)
    say = write or (lambda s: print(s, flush=True))
    spark = spark or SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").getOrCreate()
    root = located(a.project)
    at = located(a.db_path) if getattr(a, "db_path", None) else f"{root}/{FOLDER}"
    if a.command == "init":
        known = Store(spark, at).exists()
        store = sync.init(spark, at)
        say(f"{'there is an index already' if known else 'made an index'} at {at}, schema {store.schema_version()}")
        return 0
    store = sync.init(spark, at)
    if a.command in ("index", "sync"):
        try:
            done = sync.sync(store, root, getattr(a, "force", False), (lambda step: None) if a.quiet else (lambda step: say(f"{step} ...")))
        except Conflict as e:
            say(str(e))
            return 1
        if not a.quiet:
            say(report(done))
        if getattr(a, "watch", False):
            return follow(spark, store, root, a.project, say)
        return 0
    if "://" not in a.project and (other := git.mismatch(a.project, a.project)):
        say(str(other))
    gate = watch.Gate(lambda: sync.sync(store, root))
    ready = _Ready(spark, root, store, gate)
    if a.web_port is not None:
        from tessera import web

        gate.wait()
        s = web.server(ready.engine(), a.web_port, enabled=api.TOOLS)
        threading.Thread(target=s.serve_forever, daemon=True).start()
        print(f"http://127.0.0.1:{s.server_address[1]}/", file=sys.stderr)
    api.serve(ready, lines, write, api.offered())
    return 0


class _Ready:
    """An engine that is made when it is first asked, once the first sync has ended or its time is up."""

    def __init__(self, spark: SparkSession, root: str, store: Store, gate: watch.Gate) -> None:
        self._spark, self._root, self._store, self._gate = spark, root, store, gate
        self._made: api.Engine | None = None

    def engine(self) -> api.Engine:
        if self._made is None:
            self._gate.wait()
            self._made = engine(self._spark, self._root, self._store)
        return self._made

    def __getattr__(self, name: str):
        return getattr(self.engine(), name)


def follow(spark: SparkSession, store: Store, root: str, project: str, say, rounds: int | None = None) -> int:
    """Sync whenever files changed and then kept still; without rounds, until stopped."""
    if "://" not in project and (why := watch.disabled_reason(project)):
        say(f"not watching: {why}")
        return 1
    failures = 0
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        time.sleep(watch.SILENCE_MS / 1000)
        try:
            done = sync.sync(store, root)
            failures = 0
            if done.files_changed:
                say(report(done))
        except Conflict as e:
            failures += 1
            if failures > watch.RETRIES:
                say(f"stopped watching: {e}")
                return 1
            time.sleep(watch.waits(failures))
    return 0


if __name__ == "__main__":
    sys.exit(main())
