"""The engine's tools over a graph, and a line-based JSON-RPC adapter for them."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import explore as answers
from tessera.functions import presentation
from tessera.operators import aggregates, lookup, traverse
from tessera.plans.graph import PropertyGraph
from tessera.plans.schema import NODE_KINDS

#: The longest texts and paths that a tool takes, and how many rows it shows without a limit of its own.
LONGEST_TEXT, LONGEST_PATH, FOUND, RELATED, MOST_NODES, DEGREE = 10_000, 4_096, 10, 20, 250, 3
#: Rows that a reply holds at most; it says so where there are more.
REPLIED = 1_000


def checked(value: str | None, most: int, name: str, needed: bool = False) -> str | None:
    if needed and not (value and value.strip()):
        raise ValueError(f"{name} is needed")
    if value is not None and len(value) > most:
        raise ValueError(f"{name} exceeds the maximum length of {most} characters")
    return value


class Engine:
    """Tools over one graph; each gives rows. texts (path, text) is the source of the graph's files, for what shows it."""

    def __init__(self, graph: PropertyGraph, texts: DataFrame | None = None) -> None:
        self.graph, self.texts = graph, texts

    def _symbol(self, symbol: str, file: str | None) -> str | None:
        checked(symbol, LONGEST_TEXT, "symbol", True)
        checked(file, LONGEST_PATH, "file")
        row = lookup.symbol(self.graph.nodes, symbol, file).select("id").first()
        return row.id if row else None

    def status(self) -> DataFrame:
        """How many nodes and edges of each kind there are."""
        g = self.graph
        return aggregates.by_kind(g.nodes).select(F.lit("node").alias("of"), "kind", "n").unionByName(aggregates.by_kind(g.edges).select(F.lit("edge").alias("of"), "kind", "n"))

    def search(self, query: str, kind: str | None = None, limit: int = FOUND) -> DataFrame:
        """Nodes with query in their names or docstrings; an unknown kind isn't looked at."""
        checked(query, LONGEST_TEXT, "query", True)
        return lookup.search(lookup.of_known_kind(self.graph.nodes, kind, NODE_KINDS), query, (), limit)

    def callers(self, symbol: str, file: str | None = None, limit: int = RELATED) -> DataFrame:
        """What calls or uses a symbol."""
        return traverse.callers(self.graph, self._symbol(symbol, file) or "").orderBy("id", "kind", "line").limit(limit)

    def callees(self, symbol: str, file: str | None = None, limit: int = RELATED) -> DataFrame:
        """What a symbol calls or uses."""
        return traverse.callees(self.graph, self._symbol(symbol, file) or "").orderBy("id", "kind", "line").limit(limit)

    def impact(self, symbol: str, file: str | None = None, depth: int = 2) -> DataFrame:
        """(file_path, n, level): what a change of a symbol may affect, by file."""
        return traverse.impact_by_file(self.graph, self._symbol(symbol, file) or "", depth)

    def node(self, symbol: str | None = None, file: str | None = None) -> DataFrame:
        """A symbol, or all symbols of a file."""
        if not symbol and not file:
            raise ValueError("symbol or file is needed")
        return lookup.symbol(self.graph.nodes, checked(symbol, LONGEST_TEXT, "symbol"), file) if symbol else lookup.in_file(self.graph.nodes, checked(file, LONGEST_PATH, "file"))

    def files(self, path: str | None = None) -> DataFrame:
        """How many symbols each file has, of files whose path begins with path."""
        return aggregates.symbols_per_file(lookup.under(self.graph.nodes, checked(path, LONGEST_PATH, "path")))

    def view(self, symbol: str | None = None, file: str | None = None, include_imports: bool = False, max_nodes: int = MOST_NODES, degree: int = DEGREE) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges to draw around a symbol or the files whose path holds file; nodes with a colour, a size and a title."""
        n = self.graph.nodes
        seeds = n.where((F.col("name") == symbol) | (F.col("qualified_name") == symbol)).orderBy("id").limit(1) if symbol else n.where(F.col("file_path").contains(file or ""))
        nodes, edges = traverse.view(self.graph, seeds.select("id"), degree, max_nodes, include_imports)
        return nodes.withColumns({"color": presentation.colour(F.col("kind")), "title": presentation.title(F.col("kind"), F.col("qualified_name"), F.col("file_path"), F.col("start_line"))}), edges

    def explore(self, query: str, max_files: int | None = None) -> DataFrame:
        """Files in the order in which they answer a query, each with why."""
        checked(query, LONGEST_TEXT, "query", True)
        a = answers.answer(self.graph, query)
        return a.files.limit(max(1, min(max_files or a.budget.files, answers.MOST_FILES)))

    def explained(self, query: str, max_files: int | None = None) -> str:
        """The answer to a query as markdown, with source."""
        checked(query, LONGEST_TEXT, "query", True)
        texts = self.texts if self.texts is not None else self.graph.nodes.select(F.col("file_path").alias("path"), F.lit("").alias("text")).limit(0)
        return answers.explore(self.graph, query, texts, max_files)


TOOLS = ("explore", "search", "callers", "callees", "impact", "node", "status", "files")
#: What each tool takes: its parameters and their types; those that it needs come first, before the bar.
PARAMETERS = {"explore": "query:string|max_files:integer", "search": "query:string|kind:string,limit:integer", "callers": "symbol:string|file:string,limit:integer", "callees": "symbol:string|file:string,limit:integer", "impact": "symbol:string|file:string,depth:integer", "node": "|symbol:string,file:string", "status": "|", "files": "|path:string"}
#: Tools that are offered unless the environment names others.
OFFERED, OFFERED_SETTING = ("explore",), "TESSERA_TOOLS"


def offered(setting: str | None = None) -> tuple[str, ...]:
    """The tools that a setting names, by default those of the environment; without one, explore alone."""
    named = setting if setting is not None else os.environ.get(OFFERED_SETTING, "")
    return tuple(t for t in TOOLS if t in {x.strip() for x in named.split(",")}) or OFFERED


def described(tool: str) -> dict[str, Any]:
    """A tool's name, what it does, and the schema of what it takes."""
    needed, more = ([x.split(":") for x in part.split(",") if x] for part in PARAMETERS[tool].split("|"))
    return {"name": tool, "description": (getattr(Engine, tool).__doc__ or tool).strip(), "inputSchema": {"type": "object", "properties": {n: {"type": t} for n, t in (*needed, *more)}, "required": [n for n, _ in needed]}}


def called(engine: Engine, tool: str, arguments: dict[str, Any]) -> str:
    """What a tool says: rows as JSON lines, and of explore, where there is source, the answer in markdown."""
    if tool == "explore" and engine.texts is not None:
        return engine.explained(**arguments)
    rows = getattr(engine, tool)(**arguments).toJSON().take(REPLIED + 1)
    return "\n".join([*rows[:REPLIED], *([f"... more than {REPLIED} rows; ask for fewer"] if len(rows) > REPLIED else [])])


def answer(engine: Engine, message: dict[str, Any], enabled: tuple[str, ...] = OFFERED, gate: Callable[[], Any] | None = None) -> dict[str, Any] | None:
    """The reply to one JSON-RPC message; None for a notification. gate is waited for before a tool is called."""
    if not isinstance(message, dict):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no valid request"}}
    mid = message.get("id")
    reply = lambda **x: {"jsonrpc": "2.0", "id": mid, **x}
    error = lambda code, text: reply(error={"code": code, "message": text})
    method = message.get("method")
    if message.get("jsonrpc") != "2.0" or not isinstance(method, str):
        return error(-32600, "no valid request")
    if mid is None:
        return None
    if method == "initialize":
        return reply(result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": [described(t) for t in TOOLS if t in enabled]})
    if method in ("resources/list", "prompts/list"):
        return reply(result={method.split("/")[0]: []})
    if method == "graph/view":
        try:
            nodes, edges = engine.view(**(message.get("params") or {}))
            return reply(result={"nodes": [json.loads(r) for r in nodes.toJSON().collect()], "edges": [json.loads(r) for r in edges.toJSON().collect()]})
        except (ValueError, TypeError) as e:
            return error(-32602, str(e))
    if method != "tools/call":
        return error(-32601, f"no method {method}")
    p = message.get("params") or {}
    if p.get("name") not in enabled or p.get("name") not in TOOLS:
        return error(-32602, f"no tool {p.get('name')}")
    if gate is not None:
        gate()
    try:
        return reply(result={"content": [{"type": "text", "text": called(engine, p["name"], p.get("arguments") or {})}]})
    except (ValueError, TypeError) as e:
        return error(-32602, str(e))
    except Exception as e:  # noqa: BLE001  what a tool meets is told to its caller
        return error(-32603, str(e)[:500])


def serve(engine: Engine, lines=None, write: Callable[[str], Any] | None = None, enabled: tuple[str, ...] = OFFERED, gate: Callable[[], Any] | None = None) -> None:
    """Answer line by line until the input ends."""
    for line in lines if lines is not None else sys.stdin:
        if not line.strip():
            continue
        try:
            out = answer(engine, json.loads(line), enabled, gate)
        except json.JSONDecodeError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if out is not None:
            (write or (lambda s: print(s, flush=True)))(json.dumps(out))


def markdown(df: DataFrame, title: str, most: int = 100) -> str:
    """The first rows of df as a table; it says how many are shown where there are more."""
    esc = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    rows = df.take(most + 1)
    more = ["", f"The first {most} rows."] if len(rows) > most else []
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(esc, r)) + " |" for r in rows[:most]), *more])


def write_markdown(df: DataFrame, title: str, path: str | Path, most: int = 100) -> Path:
    """markdown() as a file; folders are made."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(markdown(df, title, most) + "\n")
    return at
