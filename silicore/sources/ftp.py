"""Listing and fetching logs from an FTP server laid out product/test type/lot/file.

Driver-side: files land in the folder that the streaming ingest watches. A download
appears under its name only when it is whole.
"""

from __future__ import annotations

import fnmatch
import ftplib
import gzip
import json
import os
import time
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from silicore.sources.config import Settings


class CorruptDownload(Exception):
    """The server's file is no whole gzip; fetching it again will not help."""


def replaced(tmp: str | Path, path: str | Path, tries: int = 6) -> None:
    """Put ``tmp`` in the place of ``path``; a reader that holds it for a moment is waited for, each time twice as long."""
    for k in range(tries):
        try:
            os.replace(tmp, path)
            return
        except PermissionError:
            if k == tries - 1:
                raise
            time.sleep(0.05 * 2**k)


def write_json(path: str | Path, value: object) -> None:
    """Replace a state file in one step."""
    tmp = f"{path}.{os.getpid()}.tmp"
    Path(tmp).parent.mkdir(parents=True, exist_ok=True)
    Path(tmp).write_text(json.dumps(value, indent=2, ensure_ascii=False))
    replaced(tmp, path)


def read_json(path: str | Path, default: dict) -> dict:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default


class Fetcher:
    def __init__(self, settings: Settings, connect=ftplib.FTP) -> None:
        self.settings, self.connect = settings, connect

    def __enter__(self) -> Fetcher:
        f = self.settings.ftp
        self.ftp = self.connect()
        self.ftp.connect(f["host"], f["port"])
        self.ftp.login(f["username"], f["password"])
        return self

    def __exit__(self, *_: object) -> None:
        self.ftp.close()

    def _names(self, path: str) -> list[str]:
        try:
            return sorted(n.rstrip("/").rpartition("/")[2] for n in self.ftp.nlst(path))
        except ftplib.error_perm:
            return []

    def files(self) -> Iterator[tuple[str, str, str, str]]:
        """(remote path, product, test type, file name) of every log that the settings want."""
        s, base = self.settings, self.settings.ftp["base_path"].rstrip("/")
        for product in self._names(base or "/"):
            for kind in self._names(f"{base}/{product}"):
                if not s.wanted(product, kind):
                    continue
                for lot in self._names(f"{base}/{product}/{kind}"):
                    for name in self._names(f"{base}/{product}/{kind}/{lot}"):
                        if any(fnmatch.fnmatch(name.lower(), p.lower()) for p in s.ftp["patterns"]) and not s.excluded(name):
                            yield f"{base}/{product}/{kind}/{lot}/{name}", product, kind, name

    def fetch(self, remote: str, folder: str) -> str:
        """Download one file, unpacked; its local path."""
        name = remote.rpartition("/")[2]
        target = Path(folder) / name.removesuffix(".gz")
        part = target.with_name(target.name + ".part")
        part.parent.mkdir(parents=True, exist_ok=True)
        data = bytearray()
        self.ftp.retrbinary(f"RETR {remote}", data.extend)
        try:
            part.write_bytes(gzip.decompress(bytes(data)) if name.endswith(".gz") else bytes(data))
        except (OSError, EOFError, zlib.error) as e:
            part.unlink(missing_ok=True)
            raise CorruptDownload(f"{remote}: {e}") from e
        os.replace(part, target)
        return str(target)


class History:
    """Which remote files were fetched, which were ingested, and which are damaged."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.state = dict(corrupt={}, files={}) | read_json(path, {})

    def _now(self) -> str:
        return datetime.now(UTC).isoformat()

    def known(self, remote: str) -> bool:
        return remote in self.state["files"]

    def damaged(self, remote: str) -> bool:
        return remote in self.state["corrupt"]

    def fetched(self, remote: str, product: str, kind: str, local: str) -> None:
        self.state["files"][remote] = {"product": product, "test_type": kind, "local_path": local, "downloaded_at": self._now(), "file_size": os.path.getsize(local), "ingested": False}
        self.state["corrupt"].pop(remote, None)
        write_json(self.path, self.state)

    def ingested(self, remote: str) -> None:
        self.state["files"][remote] |= {"ingested": True, "ingested_at": self._now()}
        write_json(self.path, self.state)

    def corrupt(self, remote: str, product: str, kind: str, error: str, moved_to: str | None = None) -> None:
        self.state["corrupt"][remote] = {"product": product, "test_type": kind, "error": error, "quarantine_path": moved_to, "detected_at": self._now()}
        write_json(self.path, self.state)

    def pending(self) -> list[tuple[str, dict]]:
        return [(r, f) for r, f in self.state["files"].items() if not f["ingested"]]


def quarantine(path: str, root: str) -> str:
    """Move a file that cannot be read to ``root``/_corrupt; its new place."""
    target = Path(root) / "_corrupt" / Path(path).name
    target.parent.mkdir(parents=True, exist_ok=True)
    os.replace(path, target)
    return str(target)


def fetch_new(fetcher: Fetcher, history: History, folder: str, retry_corrupt: bool = False, limit: int | None = None, test_type: str | None = None, force: bool = False) -> dict[str, list[str]]:
    """Download what is new; damaged files are noted and not tried again unless asked for.

    ``test_type``: files of that category alone, such as CP; ``force``: files that are known, too. Other errors leave no trace, so that the next run tries again.
    """
    out: dict[str, list[str]] = {"fetched": [], "corrupt": [], "failed": []}
    for remote, product, kind, _ in fetcher.files():
        if test_type is not None and not kind.upper().startswith(test_type.upper()):
            continue
        if history.known(remote) and not force or history.damaged(remote) and not retry_corrupt:
            continue
        if limit is not None and len(out["fetched"]) >= limit:
            break
        try:
            local = fetcher.fetch(remote, f"{folder}/{product}/{kind}")
            history.fetched(remote, product, kind, local)
            out["fetched"].append(local)
        except CorruptDownload as e:
            history.corrupt(remote, product, kind, str(e))
            out["corrupt"].append(remote)
        except (OSError, ftplib.Error):
            out["failed"].append(remote)
    return out
