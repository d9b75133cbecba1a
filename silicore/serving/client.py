"""Client of the query server."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from pathlib import Path

import pandas as pd


class QueryError(RuntimeError):
    """The server's own message about a query it did not run."""


class Client:
    def __init__(self, url: str = "http://localhost:8555") -> None:
        self.url = url.rstrip("/")

    def _ask(self, path: str, body: dict | None = None, timeout: float = 600) -> bytes:
        data = None if body is None else json.dumps(body).encode()
        ask = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            raise QueryError(json.loads(e.read()).get("detail", str(e))) from e

    def q(self, sql: str, limit: int | None = None) -> pd.DataFrame:
        got = json.loads(self._ask("/api/query", {"sql": sql, "limit": limit}))
        df = pd.DataFrame(got["rows"], columns=got["columns"])
        df.attrs["truncated"] = got["truncated"]
        return df

    def to_csv(self, sql: str, path: str, limit: int | None = None) -> str:
        body = self._ask("/api/query", {"format": "csv", "limit": limit, "sql": sql})
        Path(path).write_bytes(body)
        return path

    def views(self) -> dict:
        return json.loads(self._ask("/api/views", timeout=60))
