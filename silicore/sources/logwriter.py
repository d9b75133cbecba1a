"""Writer of binary tester logs, for tests and examples."""

from __future__ import annotations

import struct


def cn(s: str) -> bytes:
    raw = s.encode("ascii")
    return bytes([len(raw)]) + raw


class Writer:
    def __init__(self, big: bool = False) -> None:
        self.order = ">" if big else "<"
        self.out = bytearray()
        self.record(0, 10, bytes([1 if big else 2, 4]))

    def pack(self, code: str, *values) -> bytes:
        return struct.pack(self.order + code, *values)

    def record(self, kind: int, sub: int, body: bytes) -> None:
        self.out += self.pack("H", len(body)) + bytes([kind, sub]) + body

    def mir(self, lot: str, code: str = "CP11", part: str = "PT", job: str = "JOB", rev: str = "Rev01", tester: str = "T1", operator: str = "OP", start: int = 1_700_000_000) -> None:
        head = self.pack("IIB", start - 10, start, 1) + b"P" + b" " + b" " + self.pack("H", 0) + b" "
        self.record(1, 10, head + b"".join(map(cn, [lot, part, "NODE", tester, job, rev, "", operator, "", "", code])))

    def mrr(self, finish: int) -> None:
        self.record(1, 20, self.pack("I", finish))

    def pmr(self, index: int, channel: str = "", physical: str = "", logical: str = "") -> None:
        self.record(1, 60, self.pack("HH", index, 0) + cn(channel) + cn(physical) + cn(logical))

    def bin(self, kind: str, number: int, count: int, name: str) -> None:
        self.record(1, 40 if kind == "hard" else 50, self.pack("BBHI", 255, 0, number, count) + b"P" + cn(name))

    def wir(self, wafer: str, start: int = 1_700_000_100) -> None:
        self.record(2, 10, self.pack("BBI", 1, 255, start) + cn(wafer))

    def wrr(self, parts: int, good: int, finish: int = 1_700_003_000) -> None:
        self.record(2, 20, self.pack("BBIIIIII", 1, 255, finish, parts, 0, 0, good, 0))

    def pir(self, site: int = 0) -> None:
        self.record(5, 10, self.pack("BB", 1, site))

    def prr(self, x: int, y: int, passed: bool = True, hard: int = 1, soft: int = 1, text: str = "", site: int = 0, tests: int = 1) -> None:
        self.record(5, 20, self.pack("BBBHHHhhI", 1, site, 0 if passed else 8, tests, hard, soft, x, y, 50) + cn("1") + cn(text))

    def ptr(self, num: int, result: float, name: str = "", lo: float = 0.0, hi: float = 1.0, units: str = "V", fail: bool = False, site: int = 0, option: int = 0) -> None:
        self.record(15, 10, self.pack("IBBBBf", num, 1, site, 0x80 if fail else 0, 0, result) + cn(name) + cn("") + bytes([option, 0, 0, 0]) + self.pack("ff", lo, hi) + cn(units))

    def ftr(self, num: int, fail: bool = False, site: int = 0) -> None:
        self.record(15, 20, self.pack("IBBB", num, 1, site, 0x80 if fail else 0))

    def mpr(self, num: int, results: list[float], pins: list[int], name: str = "", units: str = "V", lo: float = 0.0, hi: float = 1.0) -> None:
        n = len(pins)
        body = self.pack("IBBBBHH", num, 1, 0, 0, 0, n, len(results)) + bytes((n + 1) // 2) + b"".join(self.pack("f", r) for r in results)
        body += cn(name) + cn("") + bytes(4) + self.pack("ffff", lo, hi, 0, 0) + b"".join(self.pack("H", p) for p in pins) + cn(units)
        self.record(15, 15, body)

    def gdr(self, *fields: tuple[int, object]) -> None:
        out = self.pack("H", len(fields))
        codes = {1: "B", 2: "H", 3: "I", 4: "b", 5: "h", 6: "i", 7: "f", 8: "d", 13: "B"}
        for code, v in fields:
            out += bytes([code])
            if code in codes:
                out += self.pack(codes[code], v)
            elif code == 10:
                out += cn(str(v))
            elif code == 11:
                out += bytes([len(v)]) + v
            elif code == 12:
                out += self.pack("H", len(v) * 8) + v
        self.record(50, 10, out)

    def bytes(self) -> bytes:
        return bytes(self.out)


def final_test(lot: str, parts: int, fail: tuple[int, ...] = (), efuses: tuple[str, str] = ("0b" + "0" * 64, "0b1" + "0" * 63)) -> bytes:
    w = Writer()
    w.mir(lot, code="FT1")
    for i in range(parts):
        w.pir()
        w.ptr(5001, 1.0, "FT_FUNC", 0, 2, fail=i in fail)
        for e in efuses:
            bits = format((int(e[2:], 2) + i) % (1 << 64), "064b")
            w.gdr((10, "EN-S0-CHIPID_R"), (10, "0b" + bits))
        w.prr(-32768, -32768, i not in fail, text=f"2D-{lot}-{i:04d}", hard=1 if i not in fail else 2, soft=1 if i not in fail else 3)
    w.mrr(1_700_003_600)
    return w.bytes()


def wafer_test(lot: str, wafers: int = 1, parts: int = 4, fail: tuple[int, ...] = (), start: int = 1_700_000_000, shift: float = 0.0) -> bytes:
    w = Writer()
    w.mir(lot, start=start)
    for k in range(wafers):
        w.wir(f"W{k + 1}")
        for i in range(parts):
            w.pir()
            w.ptr(1001, 0.5 + shift + i / 100, "Vth_N", 0.3, 0.8, fail=i in fail)
            w.prr(i, k, i not in fail, hard=1 if i not in fail else 2, soft=1 if i not in fail else 3)
        w.wrr(parts, parts - len(fail))
    w.mrr(start + 3600)
    return w.bytes()
