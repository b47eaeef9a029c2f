"""Queries of the tools and of their adapter."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import text as words
from tessera.operators import search
from tessera.operators.analytics import ROUNDS
from tessera.plans.graph import PropertyGraph
from tessera.queries.base import many, slim, sql_list
from tessera.queries.graph import BOTH, find_sql

_FOUND = "SELECT {cols} FROM nodes WHERE (contains(lower(name), '{q}') OR contains(lower(qualified_name), '{q}') OR contains(lower(docstring), '{q}')){more} ORDER BY id LIMIT {n}"
_SLIM = "id, kind, name, file_path"
_CALLS = "('calls', 'references', 'imports', 'instantiates')"


def _replies(g: PropertyGraph) -> DataFrame:
    """Codes of the adapter's replies to messages of each kind."""
    sent = ['{"jsonrpc":"2.0","id":1,"method":"initialize"}', '{"jsonrpc":"2.0","id":2,"method":"ping"}', '{"jsonrpc":"2.0","id":3,"method":"tools/list"}', '{"jsonrpc":"2.0","id":4,"method":"prompts/list"}', '{"jsonrpc":"2.0","id":5,"method":"odd"}', "no json", '{"id":7}', '{"jsonrpc":"2.0","id":8,"method":"tools/call","params":{"name":"odd"}}', '{"jsonrpc":"2.0","id":9,"method":"tools/call","params":{"name":"search","arguments":{"query":""}}}', '{"jsonrpc":"2.0","id":10,"method":"tools/call","params":{"name":"search","arguments":{"query":"nation_2"}}}', '{"jsonrpc":"2.0","method":"ping"}']
    out: list[str] = []
    api.serve(api.Engine(g), sent, out.append, ("search",))
    rows = [(i, r.get("error", {}).get("code", 0), (r.get("result") or {}).get("content", [{}])[0].get("text", "").count("\n") + 1 if i == 9 else 0) for i, r in enumerate(map(json.loads, out))]
    return g.nodes.sparkSession.createDataFrame(rows, "place int, code int, rows int")


def _guards(g: PropertyGraph) -> DataFrame:
    """Which calls are refused."""
    e, rows = api.Engine(g), []
    calls = {"search": lambda n: e.search("x" * n), "callers": lambda n: e.callers("x" * n), "callees": lambda n: e.callees("x" * n), "impact": lambda n: e.impact("x" * n), "explore": lambda n: e.explore("x" * n), "node": lambda n: e.node(file="x" * n), "files": lambda n: e.files("x" * n)}
    for name, call in calls.items():
        try:
            call(20_000)
            rows.append((name, False))
        except ValueError as error:
            rows.append((name, "maximum length" in str(error)))
    return g.nodes.sparkSession.createDataFrame(rows, "tool string, refused boolean")


def explore_sql(text: str) -> str:
    """CTEs ending in ranked (file_path, hits, score, named): the files that answer a query, from the rules of exploring in SQL."""
    has = lambda t: f"(contains(lower(name), '{t}') OR contains(lower(qualified_name), '{t}') OR coalesce(contains(lower(docstring), '{t}'), false))"
    tokens = list(dict.fromkeys(words.symbols(text)))
    ways = " UNION ALL ".join(f"SELECT id, {i} AS ord, CASE WHEN qualified_name = '{t}' THEN 0 WHEN name = '{t}' THEN 1 WHEN {has(t.lower())} THEN 2 END AS way FROM nodes" for i, t in enumerate(tokens))
    hits = " + ".join(f"max((contains(lower(name), '{w}') OR contains(lower(file_path), '{w}'))::INT)" for w in dict.fromkeys(text.lower().split()) if len(w) >= 3)
    rounds = "".join(f""",
     s{k + 1} AS MATERIALIZED (SELECT s0.id, 0.75 * CASE WHEN any_value(s0.lone) THEN any_value(prev.s) ELSE coalesce(sum(w.p * x.s), 0) END + 0.25 * any_value(s0.s) AS s FROM s0 JOIN s{k} prev ON prev.id = s0.id LEFT JOIN w ON w.t = s0.id LEFT JOIN s{k} x ON x.id = w.a GROUP BY s0.id)""" for k in range(ROUNDS))
    relevant = sql_list(search.RELEVANT_KINDS)
    low = "contains(lower(file_path), '/test/')"
    return f"""{find_sql(text)}, k AS (SELECT b.at, b.go FROM {BOTH} b WHERE b.kind IN ({relevant})),
     reach AS (SELECT id, 0 AS level FROM found UNION SELECT k.go, level + 1 FROM reach JOIN k ON k.at = reach.id WHERE level < 3),
     around AS (SELECT id FROM (SELECT id, min(level) AS level FROM reach GROUP BY id) ORDER BY level, id LIMIT 100),
     calls AS (SELECT source AS id FROM edges WHERE target IN (SELECT id FROM found) AND kind IN {_CALLS} UNION SELECT target FROM edges WHERE source IN (SELECT id FROM found) AND kind IN {_CALLS}),
     glue AS (SELECT id FROM nodes WHERE id IN (SELECT id FROM calls) AND id NOT IN (SELECT id FROM around) AND file_path IN (SELECT file_path FROM nodes WHERE id IN (SELECT id FROM around)) ORDER BY id LIMIT 60),
     ways AS ({ways}), seeds AS (SELECT id FROM (SELECT id, ord, way, min(way) OVER (PARTITION BY ord) AS best FROM ways WHERE way IS NOT NULL) WHERE way = best GROUP BY id ORDER BY min(ord), id LIMIT 40),
     ids AS MATERIALIZED (SELECT id FROM around UNION SELECT id FROM glue UNION SELECT id FROM seeds), entries AS (SELECT id FROM found UNION SELECT id FROM seeds),
     inner_edges AS MATERIALIZED (SELECT source, target, kind FROM edges WHERE kind IN ({relevant}) AND source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)),
     near AS (SELECT target AS id FROM inner_edges WHERE source IN (SELECT id FROM entries) UNION SELECT source FROM inner_edges WHERE target IN (SELECT id FROM entries)),
     mine AS MATERIALIZED (SELECT * FROM nodes WHERE id IN (SELECT id FROM ids)),
     b2 AS (SELECT source AS a, target AS t FROM inner_edges WHERE kind <> 'contains' UNION ALL SELECT target, source FROM inner_edges WHERE kind <> 'contains'),
     w AS MATERIALIZED (SELECT a, t, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM b2 WHERE a <> t GROUP BY a, t),
     s0 AS MATERIALIZED (SELECT id, CASE WHEN id IN (SELECT id FROM entries) THEN 1.0::DOUBLE / (SELECT count(*) FROM entries) ELSE 0 END AS s, id NOT IN (SELECT a FROM w) AS lone FROM ids){rounds},
     graph AS (SELECT file_path, sum(s) AS graph_score FROM mine JOIN s{ROUNDS} ON s{ROUNDS}.id = mine.id GROUP BY file_path),
     scored AS (SELECT file_path, sum(CASE WHEN id IN (SELECT id FROM seeds) THEN 50 WHEN id IN (SELECT id FROM entries) THEN 10 WHEN id IN (SELECT id FROM near) THEN 3 ELSE 1 END) AS score, count(*) AS n, {hits} AS hits FROM mine WHERE kind NOT IN ('import', 'export') GROUP BY file_path HAVING sum(CASE WHEN id IN (SELECT id FROM seeds) THEN 50 WHEN id IN (SELECT id FROM entries) THEN 10 WHEN id IN (SELECT id FROM near) THEN 3 ELSE 1 END) >= 3),
     sizes AS (SELECT count(DISTINCT file_path) AS n FROM nodes),
     kept AS (SELECT * FROM scored WHERE (SELECT n FROM sizes) >= 500 OR NOT {low} OR (SELECT count(*) FROM scored WHERE NOT {low}) < 2),
     files AS (SELECT kept.*, graph_score, file_path IN (SELECT file_path FROM mine WHERE id IN (SELECT id FROM seeds)) AS named, file_path IN (SELECT file_path FROM mine WHERE id IN (SELECT id FROM entries)) AS entry FROM kept JOIN graph USING (file_path)),
     central AS (SELECT file_path FROM files WHERE hits >= 1 AND graph_score > 0 ORDER BY graph_score DESC, file_path LIMIT 2),
     judged AS (SELECT files.*, file_path IN (SELECT file_path FROM central) AS central, max(graph_score) OVER () AS top FROM files),
     passed AS (SELECT *, graph_score >= 0.06::DOUBLE * top OR named OR entry OR central OR hits >= 2 AS passes FROM judged),
     ranked AS (SELECT file_path, hits, score, named, row_number() OVER (ORDER BY named DESC, (central OR entry) AND hits >= 2 DESC, floor(graph_score / (0.01::DOUBLE * top)) DESC, hits DESC, {low}, score DESC, n DESC, file_path) AS place FROM passed WHERE passes OR (SELECT count(*) FROM passed WHERE passes) < 2)"""


_MOST = "(SELECT CASE WHEN n < 150 THEN 4 WHEN n < 500 THEN 5 ELSE 8 END FROM sizes)"

many(
    ("e1_explore", lambda g: api.Engine(g).explore("order201 NATION_2", 3).where("named").select("file_path", "named"), "SELECT * FROM (VALUES ('geo/r2/N2.java', true), (concat('sales/orders/', (SELECT o_orderpriority FROM orders WHERE o_orderkey = 201), '.java'), true)) AS t(file_path, named)"),
    ("e2_search", lambda g: slim(api.Engine(g).search("nation_1")), _FOUND.format(cols=_SLIM, q="nation_1", more="", n=10)),
    ("f25_unknown_kind", lambda g: slim(api.Engine(g).search("nation_1", "no such kind", 40)).unionByName(slim(api.Engine(g).search("ring", "class", 40))), f"SELECT * FROM ({_FOUND.format(cols=_SLIM, q='nation_1', more='', n=40)}) UNION ALL SELECT * FROM ({_FOUND.format(cols=_SLIM, q='ring', more=chr(32) + 'AND kind = ' + chr(39) + 'class' + chr(39), n=40)})"),
    ("t8_limits", lambda g: api.Engine(g).callers("supplier#000000001").select("id", "kind"), f", s AS (SELECT id FROM nodes WHERE lower(name) = 'supplier#000000001' ORDER BY id LIMIT 1) SELECT source AS id, kind FROM edges WHERE target IN (SELECT id FROM s) AND kind IN {_CALLS} ORDER BY source, kind, line LIMIT 20"),
    ("e3_callers", lambda g: api.Engine(g).callers("doc7", limit=5).select("id", "kind"), f"SELECT source AS id, kind FROM edges WHERE target = 'doc:7' AND kind IN {_CALLS} ORDER BY source, kind, line LIMIT 5"),
    ("e4_callees", lambda g: api.Engine(g).callees("order201", limit=50).select("id", "kind"), f"SELECT target AS id, kind FROM edges WHERE source = 'order:201' AND kind IN {_CALLS} ORDER BY target, kind, line LIMIT 50"),
    ("e5_impact", lambda g: api.Engine(g).impact("doc7").select("file_path", "n"), ", r AS (SELECT 'doc:7' AS id, 0 AS level UNION SELECT e.source, level + 1 FROM r JOIN edges e ON e.target = r.id WHERE level < 2 AND e.kind <> 'contains') SELECT file_path, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM r) GROUP BY file_path"),
    ("e6_node", lambda g: slim(api.Engine(g).node("NATION_2")).unionByName(slim(api.Engine(g).node(file="geo/r1/N1.java"))), f"SELECT {_SLIM} FROM nodes WHERE name = 'NATION_2' UNION ALL SELECT {_SLIM} FROM nodes WHERE file_path = 'geo/r1/N1.java'"),
    ("e7_status", lambda g: api.Engine(g).status(), "SELECT 'node' AS of, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind"),
    ("e8_files", lambda g: api.Engine(g).files("geo/"), "SELECT file_path, count(*) AS n FROM nodes WHERE starts_with(file_path, 'geo/') GROUP BY file_path"),
    ("e9_view", lambda g: api.Engine(g).view("NATION_2", max_nodes=40, degree=1)[0].select("id", "level", "color"), ", n1 AS (SELECT 'nation:2' AS id, 0 AS level UNION SELECT CASE WHEN source = 'nation:2' THEN target ELSE source END, 1 FROM edges WHERE kind NOT IN ('imports', 'exports', 'references') AND 'nation:2' IN (source, target)), n2 AS (SELECT id, min(level) AS level FROM n1 GROUP BY id ORDER BY min(level), id LIMIT 40) SELECT n2.id, CAST(n2.level AS INT) AS level, CASE n.kind WHEN 'module' THEN '#6b7280' WHEN 'class' THEN '#f59e0b' WHEN 'interface' THEN '#eab308' END AS color FROM n2 JOIN nodes n ON n.id = n2.id"),
    ("e11_replies", _replies, "SELECT CAST(place AS INT) AS place, CAST(code AS INT) AS code, CAST(n AS INT) AS rows FROM (VALUES (0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, -32601, 0), (5, -32700, 0), (6, -32600, 0), (7, -32602, 0), (8, -32602, 0), (9, 0, 10)) AS t(place, code, n)"),
    ("e12_guards", _guards, "SELECT unnest(['search', 'callers', 'callees', 'impact', 'explore', 'node', 'files']) AS tool, true AS refused"),
    ("e13_offered", lambda g: g.nodes.sparkSession.createDataFrame([("none", ",".join(api.offered(""))), ("some", ",".join(api.offered("files, search, odd")))], "setting string, tools string"), "SELECT * FROM (VALUES ('none', 'explore'), ('some', 'search,files')) AS t(setting, tools)"),
    ("e_explore", lambda g: api.Engine(g).explore("order201 redPlate customer").select("file_path", "hits", "score"), f", {explore_sql('order201 redPlate customer')} SELECT file_path, hits, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= {_MOST}"),
    ("r25_explored", lambda g: api.Engine(g).explore("NATION_2 order3 red", 12).select("file_path", "hits", "named"), f", {explore_sql('NATION_2 order3 red')} SELECT file_path, hits, named FROM ranked WHERE place <= 12"),
)
