"""Settings from a YAML-like file: sections of ``key: value`` pairs and lists, no anchors.

Order: an explicit path, then ``SILICORE_CONFIG``, then ``config.yaml`` in the working
directory; without any, defaults. ``${NAME}`` in a value is taken from the environment.
"""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass, field
from pathlib import Path


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s.lower(), s)


def parse_yaml(text: str):
    """Nested mappings and lists by indentation: what settings files use of YAML."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", r).rstrip() for r in text.splitlines()) if x.strip()]

    def block(i: int, depth: int):
        out = None
        while i < len(lines) and lines[i][0] >= depth:
            ind, s = lines[i]
            if ind > depth:
                break
            if s.startswith("- ") or s == "-":
                out = [] if out is None else out
                rest = s[2:].strip()
                if re.match(r"^[\w.\-]+:(\s|$)", rest):
                    lines[i] = (ind + 2, rest)
                    item, i = block(i, ind + 2)
                else:
                    item, i = _scalar(rest), i + 1
                out.append(item)
            else:
                out = {} if out is None else out
                key, _, rest = s.partition(":")
                if rest.strip():
                    out[key.strip()], i = _scalar(rest), i + 1
                elif i + 1 < len(lines) and (lines[i + 1][0] > ind or lines[i + 1][0] == ind and lines[i + 1][1].startswith("-")):
                    out[key.strip()], i = block(i + 1, lines[i + 1][0])
                else:
                    out[key.strip()], i = None, i + 1
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


@dataclass
class Settings:
    data_dir: str = "./data"
    download_dir: str = "./downloads"
    compression: str = "zstd"
    max_rows: int = 10_000
    port: int = 8555
    host: str = "0.0.0.0"
    ftp: dict = field(default_factory=lambda: {"host": "localhost", "port": 21, "username": "", "password": "", "base_path": "/", "patterns": ["*.std*"]})
    exclude: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    products: dict = field(default_factory=dict)

    @property
    def gross_die(self) -> dict:
        return {p: (int(v["gross_die"]), int(v.get("gd_fail_bin") or 200)) for p, v in self.products.items() if v and v.get("gross_die") is not None}

    def for_env(self, env: str | None) -> Settings:
        """A separate data folder for each named environment."""
        if env:
            self.data_dir = f"{self.data_dir.rstrip('/')}-{env}"
            self.download_dir = f"{self.download_dir.rstrip('/')}-{env}"
        return self

    def excluded(self, name: str) -> bool:
        return any(fnmatch.fnmatch(name.lower(), p.lower()) for p in self.exclude)

    def wanted(self, product: str, kind: str) -> bool:
        """Whether the filters let a product and test type (by prefix) through; none let CP and FT through."""
        rules = self.filters or [{}]
        for f in rules:
            kinds = f.get("test_types") or ([] if "test_types" in f else ["CP", "FT"])
            if f.get("product") in (None, product) and (not kinds or any(kind.upper().startswith(k.upper()) for k in kinds)):
                return True
        return False


def load(path: str | None = None) -> Settings:
    found = path or os.environ.get("SILICORE_CONFIG") or ("config.yaml" if Path("config.yaml").exists() else None)
    if found is None or not Path(found).exists():
        return Settings()
    text = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), Path(found).read_text())
    raw = parse_yaml(text) or {}
    out = Settings()
    storage, server = raw.get("storage") or {}, raw.get("server") or {}
    out.data_dir, out.download_dir = storage.get("data_dir", out.data_dir), storage.get("download_dir", out.download_dir)
    out.compression = (raw.get("processing") or {}).get("compression", out.compression)
    out.host, out.port, out.max_rows = server.get("host", out.host), server.get("port", out.port), server.get("max_rows", out.max_rows)
    out.ftp |= raw.get("ftp") or {}
    out.filters, out.exclude, out.products = raw.get("filters") or [], raw.get("exclude") or [], raw.get("products") or {}
    return out
