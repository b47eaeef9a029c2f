"""A small HTTP server: the drawn graph as a page, and the JSON-RPC adapter for it."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer
from socketserver import ThreadingMixIn

from tessera import api

#: Threads that answer, where messages are sent, and the longest message.
THREADS, ENDPOINT, LONGEST = 4, "/api/mcp", 1 << 20

PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>tessera</title>
<style>body{font-family:sans-serif;margin:0}#bar{padding:8px;background:#f1f5f9}svg{width:100vw;height:90vh}line{stroke:#cbd5e1}text{font-size:10px}</style></head>
<body><div id="bar"><input id="symbol" placeholder="symbol"> <button onclick="draw()">show</button> <span id="said"></span></div><svg id="graph"></svg>
<script>
async function draw() {
  const sent = {jsonrpc: "2.0", id: 1, method: "graph/view", params: {symbol: document.getElementById("symbol").value}};
  const got = await (await fetch("%s", {method: "POST", body: JSON.stringify(sent)})).json();
  const said = document.getElementById("said"), svg = document.getElementById("graph");
  svg.replaceChildren();
  if (got.error) { said.textContent = got.error.message; return; }
  const {nodes, edges} = got.result, place = {}, w = svg.clientWidth, h = svg.clientHeight;
  said.textContent = nodes.length + " nodes, " + edges.length + " edges";
  const put = (kind, marks) => { const e = document.createElementNS("http://www.w3.org/2000/svg", kind); for (const k in marks) e.setAttribute(k, marks[k]); svg.appendChild(e); return e; };
  nodes.forEach((n, i) => { const a = 2 * Math.PI * i / nodes.length, r = (0.15 + 0.1 * n.level) * Math.min(w, h); place[n.id] = [w / 2 + r * Math.cos(a), h / 2 + r * Math.sin(a)]; });
  edges.forEach(e => { const a = place[e.source], b = place[e.target]; if (a && b) put("line", {x1: a[0], y1: a[1], x2: b[0], y2: b[1]}); });
  nodes.forEach(n => { const [x, y] = place[n.id]; const c = put("circle", {cx: x, cy: y, r: n.size / 3, fill: n.color}); const t = document.createElementNS("http://www.w3.org/2000/svg", "title"); t.textContent = n.title; c.appendChild(t); put("text", {x: x + 8, y: y}).textContent = n.name; });
}
</script></body></html>
""" % ENDPOINT


class _Pooled(ThreadingMixIn, HTTPServer):
    """Requests are answered by so many threads at most."""

    def __init__(self, at: tuple[str, int], handler: type[BaseHTTPRequestHandler]) -> None:
        super().__init__(at, handler)
        self.pool = ThreadPoolExecutor(THREADS)

    def process_request(self, request, client_address) -> None:
        self.pool.submit(self.process_request_thread, request, client_address)

    def server_close(self) -> None:
        super().server_close()
        self.pool.shutdown(wait=False)


def server(engine: api.Engine, port: int = 0, host: str = "127.0.0.1", enabled: tuple[str, ...] = api.OFFERED) -> _Pooled:
    """A server for engine, ready for serve_forever(); port 0 takes a free one. It listens on this machine alone unless told otherwise."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, kind: str, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path.split("?")[0] in ("/", "/index.html"):
                self._reply(200, "text/html; charset=utf-8", PAGE.encode())
            else:
                self._reply(404, "text/plain", b"not found")

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != ENDPOINT:
                self._reply(404, "text/plain", b"not found")
            elif size > LONGEST:
                self._reply(413, "text/plain", b"too long")
            else:
                try:
                    out = api.answer(engine, json.loads(self.rfile.read(size)), enabled)
                except json.JSONDecodeError:
                    out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
                self._reply(204 if out is None else 200, "application/json", b"" if out is None else json.dumps(out).encode())

        def log_message(self, *_) -> None:
            """Silent."""

    return _Pooled((host, port), Handler)
