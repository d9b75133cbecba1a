"""Read-only SQL over HTTP: GET /health, /api/views and /, POST /api/query.

One Spark session serves all; each request gets a session of its own over the same
tables, runs under a job group, and is cancelled when it takes too long.
"""

from __future__ import annotations

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from silicore.plans.views import Model
from silicore.serving import gate
from silicore.serving.export import csv_lines, plain

PAGE = b"<!doctype html><title>silicore</title><h1>silicore</h1><p>POST /api/query with {\"sql\": ..., \"limit\": ..., \"format\": \"json\" or \"csv\"}; GET /api/views lists the views.</p>"


class Service:
    def __init__(self, spark: SparkSession, model, max_rows: int = 10_000, timeout: float = 600.0) -> None:
        """``model``: a function of a session that gives the ``Model``, called for every request."""
        self.spark, self.model, self.max_rows, self.timeout = spark, model, max_rows, timeout

    def _session(self) -> tuple[SparkSession, list[str]]:
        own = self.spark.newSession()
        own.conf.set("spark.sql.runSQLOnFiles", "false")
        own.conf.set("spark.sql.session.timeZone", "UTC")
        m: Model = self.model(own)
        return own, m.register() + (["gross_die"] if m.gross_die is not None else [])

    def views(self) -> dict[str, list[dict[str, str]]]:
        own, names = self._session()
        return {n: [{"name": f.name, "type": f.dataType.simpleString()} for f in own.table(n).schema] for n in names}

    def query(self, sql: str, limit: int | None = None) -> tuple[list[str], list, bool]:
        """Columns, rows up to the cap, and whether there were more."""
        own, names = self._session()
        df = gate.run(own, sql, set(names))
        cap = self.max_rows if limit is None else max(0, min(int(limit), self.max_rows))
        group = uuid.uuid4().hex
        sc = own.sparkContext
        sc.setJobGroup(group, sql[:200], interruptOnCancel=True)
        timer = threading.Timer(self.timeout, sc.cancelJobGroup, [group])
        timer.start()
        try:
            rows = df.limit(cap + 1).collect()
        finally:
            timer.cancel()
        return df.columns, rows[:cap], len(rows) > cap


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: bytes, kind: str = "application/json", **headers: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body)

        def _json(self, code: int, value: object) -> None:
            self._send(code, json.dumps(value).encode())

        def do_GET(self) -> None:
            if self.path == "/health":
                self._json(200, {"status": "ok"})
            elif self.path == "/api/views":
                self._json(200, service.views())
            elif self.path == "/":
                self._send(200, PAGE, "text/html; charset=utf-8")
            else:
                self._json(404, {"detail": "not found"})

        def do_POST(self) -> None:
            if self.path != "/api/query":
                self._json(404, {"detail": "not found"})
                return
            try:
                ask = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                kind = ask.get("format", "json")
                if kind not in ("json", "csv"):
                    raise gate.Refused(f"no such format: {kind}")
                columns, rows, more = service.query(str(ask["sql"]), ask.get("limit"))
            except (gate.Refused, KeyError, ValueError, TypeError) as e:
                self._json(400, {"detail": str(e)})
                return
            except Exception as e:  # noqa: BLE001 - the query's own failure is the client's to see
                self._json(400, {"detail": str(e).splitlines()[0]})
                return
            if kind == "csv":
                self._send(200, "".join(csv_lines(columns, iter(rows))).encode(), "text/csv; charset=utf-8", Content_Disposition="attachment; filename=result.csv")
            else:
                self._json(200, {"truncated": more, "row_count": len(rows), "columns": columns, "rows": [[plain(v) for v in r] for r in rows]})

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8555) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(service))
