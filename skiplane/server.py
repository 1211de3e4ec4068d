"""The engine over HTTP, with the standard library alone.

POST /query {"sql"}, POST /load {"table", "data" (CSV text with a header),
"dimensions", "numeric_dimensions", "bucket_counts"}, GET /tables, GET /health.
400: what was sent is wrong; 404: no such table or route; 500: anything else.
Responses are for small results; ``MOST_ROWS`` and ``MOST_BYTES`` bound them and
what may be loaded; larger tables come by ``Engine.load``.
"""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import AnalysisException, ParseException

from skiplane.operators.layout import Dimension, Layout
from skiplane.plans.engine import Engine, UnknownTable
from skiplane.sources.segments import WriterStats

MOST_BYTES = 64 << 20
DIMENSIONS, BUCKETS = 3, 16


class BadRequest(ValueError):
    pass


def _plain(value: object) -> object:
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value) if isinstance(value, decimal.Decimal) else value.decode("latin-1") if isinstance(value, (bytes, bytearray)) else str(value)


def query(engine: Engine, body: dict) -> dict:
    sql = body.get("sql")
    if not isinstance(sql, str) or not sql.strip():
        raise BadRequest("sql is missing")
    return engine.query(sql).envelope()


def load(engine: Engine, body: dict) -> dict:
    """The first load of a table fixes its layout; later ones append and needn't repeat it."""
    began, name = time.perf_counter(), body.get("table")
    if not isinstance(name, str) or not isinstance(body.get("data"), str):
        raise BadRequest("table and data are needed")
    header, *rows = list(csv.reader(io.StringIO(body["data"]))) or [[]]
    rows = [r for r in rows if r]
    if not header or any(len(r) != len(header) for r in rows):
        raise BadRequest("every row needs as many fields as the header")
    numeric = set(body.get("numeric_dimensions") or [])
    known = engine.table(name) if name in engine.names() else None
    layout = None
    if known is None:
        names = list(body.get("dimensions") or header[:DIMENSIONS])
        sizes = list(body.get("bucket_counts") or [BUCKETS] * len(names))
        if not set(names) <= set(header) or len(sizes) < len(names):
            raise BadRequest("dimensions are columns, with a number of buckets each")
        layout = Layout(tuple(Dimension(n, "magnitude" if n in numeric else "hash", int(k)) for n, k in zip(names, sizes, strict=False)))
    else:
        numeric = {d.name for d in known.layout.dimensions if d.kind == "magnitude"}
    df = engine.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in header))
    stats: WriterStats = engine.load(name, df.select(*[df[f"`{c}`"].try_cast("double").alias(c) if c in numeric else df[f"`{c}`"] for c in header]), layout).last_write
    return {"table": name, "rows_loaded": stats.rows, "segments": stats.segments, "elapsed_ms": round((time.perf_counter() - began) * 1000, 3)}


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    routes = {("POST", "/query"): query, ("POST", "/load"): load, ("GET", "/health"): lambda e, _: e.health(), ("GET", "/tables"): lambda e, _: [r.asDict() for r in e.tables().collect()]}

    def _answer(self, status: int, body: object) -> None:
        data = json.dumps(body, default=_plain).encode()
        self.send_response(status)
        for name, value in {"Content-Type": "application/json", "Content-Length": str(len(data)), "Access-Control-Allow-Origin": "*", "Access-Control-Allow-Headers": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS"}.items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(data)

    def _serve(self) -> None:
        route = self.routes.get((self.command, self.path.partition("?")[0]))
        if route is None:
            return self._answer(404, {"error": "no such route"})
        try:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                raise BadRequest(f"more than {MOST_BYTES} bytes")
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError as e:
                raise BadRequest(str(e)) from e
            self._answer(200, route(self.engine, body))
        except UnknownTable as e:
            self._answer(404, {"error": f"no table {e.args[0]}"})
        except AnalysisException as e:
            self._answer(404 if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" else 400, {"error": str(e).split("\n")[0]})
        except (BadRequest, ParseException, ValueError) as e:
            self._answer(400, {"error": str(e).split("\n")[0]})
        except Exception as e:  # what is left is the server's own fault, and must be answered
            self._answer(500, {"error": str(e).split("\n")[0]})

    do_GET = do_POST = _serve

    def do_OPTIONS(self) -> None:
        self._answer(200, {})

    def log_message(self, *args: object) -> None:
        pass


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``; port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"engine": engine}))
