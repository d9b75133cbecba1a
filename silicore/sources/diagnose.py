"""What is wrong with a gzip file: its members, where they end, and how two downloads differ."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field


@dataclass
class Member:
    offset: int
    packed: int
    plain: int
    whole: bool
    error: str = ""


@dataclass
class Report:
    size: int
    members: list[Member] = field(default_factory=list)
    trailing: int = 0
    later_headers: list[int] = field(default_factory=list)

    @property
    def verdict(self) -> str:
        if not self.members:
            return "not gzip"
        if all(m.whole for m in self.members):
            return "ok" if not self.trailing else "bytes after the last member"
        return "truncated" if self.members[-1].error == "" else "damaged"


def gzip_report(data: bytes, step: int = 1 << 20) -> Report:
    """Walk the members of a gzip file, holding no more than ``step`` plain bytes."""
    out, at = Report(len(data)), 0
    while data[at : at + 2] == b"\x1f\x8b":
        z, plain, error, i = zlib.decompressobj(31), 0, "", at
        try:
            while not z.eof and i < len(data):
                part = data[i : i + step]
                i += len(part)
                plain += len(z.decompress(part, step))
                while z.unconsumed_tail:
                    plain += len(z.decompress(z.unconsumed_tail, step))
        except zlib.error as e:
            error = str(e)
        end = i - len(z.unused_data) if z.eof else len(data)
        out.members.append(Member(at, end - at, plain, z.eof and not error, error))
        if error or not z.eof:
            begin = at + 2
            while (begin := data.find(b"\x1f\x8b\x08", begin)) >= 0:
                out.later_headers.append(begin)
                begin += 1
            return out
        at = end
    out.trailing = len(data) - at if out.members else 0
    return out


def compare_downloads(first: bytes, second: bytes) -> str:
    """Whether the fault lies with the transfer or with the file on the server."""
    same = hashlib.sha256(first).digest() == hashlib.sha256(second).digest()
    a, b = gzip_report(first).verdict, gzip_report(second).verdict
    if same:
        return "both downloads are whole" if a == "ok" else f"the server's file itself: {a}"
    return "the transfer: the downloads differ" + (", one of them is whole" if "ok" in (a, b) else "")
