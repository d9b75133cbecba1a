"""Reader of binary tester logs (version 4 records: u16 length, u8 type, u8 subtype, body).

``read_logs`` is one task a file: a file cannot be split, since records are found only
by walking from its start. A parsed file is yielded in batches of rows of one wide
schema, tagged by ``kind``; nothing of a file is kept on the driver. Measurements are given
out during the walk, as soon as no record to come can change their part, so a task holds a
batch of them and not the log's; the lot's row comes last, and rows of a log without one
do not count.

By default a log's parts and measurements are bound as the flow goes (one part at a
time, limits as they stand in the record). ``strict=True`` binds them by head and site,
so that parts of several sites may interleave, and takes limits that the option flags
declare invalid as missing.

Defined results: an empty file gives no rows; a record cut off by the end of the file is
dropped with all after it; a record whose body cannot be read is skipped; unknown records
and unread rests of known ones are skipped; zero-length records too.
"""

from __future__ import annotations

import contextlib
import gzip
import signal
import struct
import threading
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHIP_KEYS = ("EN-S0-CHIPID_R", "EN-SO-CHIPID_R")
BATCH = 65_536

SCHEMA = (
    "file string, kind string, record_no bigint, error string, lot_id string, part_type string, job_name string, job_rev string, tester_type string, operator string, test_code string, start_t bigint, finish_t bigint, "
    "wafer_id string, head_num bigint, site_num bigint, part_count bigint, good_count bigint, rtst_count bigint, abrt_count bigint, part_id string, part_txt string, x_coord bigint, y_coord bigint, hard_bin bigint, soft_bin bigint, passed boolean, "
    "test_count bigint, test_time bigint, test_num bigint, test_name string, rec_type string, lo_limit double, hi_limit double, units string, result double, pin_num bigint, pin_name string, chip_index bigint, efuse string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])


class _Cut(Exception):
    """The file ended inside a record."""


class Body:
    """Fields of one record, read in order. Past the end of the record optional fields give
    their default; what is required there reads on into the file."""

    __slots__ = ("at", "data", "end", "order")

    def __init__(self, data: bytes, at: int, end: int, order: str) -> None:
        self.data, self.at, self.end, self.order = data, at, end, order

    def _take(self, code: str, size: int):
        if self.at + size > len(self.data):
            raise _Cut
        v = struct.unpack_from(self.order + code, self.data, self.at)[0]
        self.at += size
        return v

    def more(self) -> bool:
        return self.at < self.end

    def u1(self) -> int:
        return self._take("B", 1)

    def u2(self) -> int:
        return self._take("H", 2)

    def u4(self) -> int:
        return self._take("I", 4)

    def i2(self) -> int:
        return self._take("h", 2)

    def r4(self) -> float:
        return self._take("f", 4)

    def cn(self) -> str:
        n = self.u1()
        raw = self.data[self.at : self.at + n]
        self.at += len(raw)
        return text(raw)

    def opt(self, read: str, default=None):
        return getattr(self, read)() if self.at < self.end else default


def text(raw: bytes) -> str:
    return raw.decode("ascii", "replace").replace("\0", "").strip()


@dataclass
class Log:
    """What one walk through a file gathers."""

    lot: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)
    chips: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    wafers: list = field(default_factory=list)
    tests: dict[int, dict] = field(default_factory=dict)
    pins: dict[int, str] = field(default_factory=dict)
    bins: dict[tuple[str, int], dict] = field(default_factory=dict)
    skipped: int = 0


class Walker:
    def __init__(self, strict: bool = False) -> None:
        self.log, self.strict, self.order = Log(), strict, "<"
        self.wafer, self.counter, self.no, self.measured = "", 0, 0, 0
        self.part: dict[tuple[int, int] | None, str] = {}
        self.efuses: dict[tuple[int, int] | None, list[str]] = {}
        self.kinds = {
            (0, 10): self.far, (1, 10): self.mir, (1, 20): self.mrr, (1, 40): self.hbr, (1, 50): self.sbr, (1, 60): self.pmr, (2, 10): self.wir, (2, 20): self.wrr,
            (5, 10): self.pir, (5, 20): self.prr, (15, 10): self.ptr, (15, 15): self.mpr, (15, 20): self.ftr, (50, 10): self.gdr,
        }

    def walk(self, data: bytes) -> Log:
        for _ in self.steps(data):
            pass
        return self.log

    def steps(self, data: bytes) -> Iterator[None]:
        """Walk over the records; a step ends with a part."""
        at = 0
        if data[2:4] == b"\0\x0a" and len(data) > 4:  # the file's own byte order, before its first length is read
            self.order = ">" if data[4] == 1 else "<"
        while at + 4 <= len(data):
            size, kind, sub = struct.unpack_from(self.order + "HBB", data, at)
            at += 4
            if size == 0:
                continue
            self.no += 1
            read = self.kinds.get((kind, sub))
            if read:
                body = Body(data, at, at + size, self.order)
                try:
                    read(body)
                except _Cut:
                    break
                except Exception:  # noqa: BLE001 - a damaged record is skipped, those after it are not
                    self.log.skipped += 1
                at = max(at + size, body.at)
                if (kind, sub) == (5, 20):
                    yield
            else:
                at += size

    def finished(self) -> list[dict]:
        """Take the measurements whose part no later record can touch out of the log."""
        still = {*self.part.values(), self._name()}
        rows, self.log.rows = self.log.rows, []
        done = []
        for r in rows:
            (self.log.rows if r["part_id"] in still else done).append(r)
        return done

    # -- what the log is about

    def far(self, b: Body) -> None:
        self.order = ">" if b.u1() == 1 else "<"

    def mir(self, b: Body) -> None:
        b.u4()
        start = b.u4()
        b.u1()
        for _ in range(3):
            b.opt("u1")
        b.opt("u2")
        b.opt("u1")
        names = ["lot_id", "part_type", "node", "tester_type", "job_name", "job_rev", "sublot", "operator", "exec_type", "exec_ver", "test_code"]
        got = {n: b.opt("cn", "") for n in names}
        self.log.lot |= {n: got[n] for n in ("lot_id", "part_type", "tester_type", "job_name", "job_rev", "operator", "test_code")} | {"start_t": start}

    def mrr(self, b: Body) -> None:
        self.log.lot["finish_t"] = b.u4()

    def _bin(self, kind: str, b: Body) -> None:
        b.u1()
        b.u1()
        n, count = b.u2(), b.u4()
        flag = chr(b.u1()) if b.more() else ""
        self.log.bins[kind, n] = {"count": count, "flag": flag, "name": b.opt("cn", "")}

    def hbr(self, b: Body) -> None:
        self._bin("hard", b)

    def sbr(self, b: Body) -> None:
        self._bin("soft", b)

    def pmr(self, b: Body) -> None:
        index = b.u2()
        b.opt("u2")
        channel, physical, logical = (b.opt("cn", "") for _ in range(3))
        self.log.pins[index] = logical or physical or channel

    def wir(self, b: Body) -> None:
        head = b.u1()
        b.opt("u1")
        start = b.opt("u4", 0)
        self.wafer = b.opt("cn", "")
        self.log.wafers.append({"wafer_id": self.wafer, "head_num": head, "start_t": start})

    def wrr(self, b: Body) -> None:
        b.u1()
        b.opt("u1")
        got = {n: b.opt("u4", 0) for n in ("finish_t", "part_count", "rtst_count", "abrt_count", "good_count")}
        if self.log.wafers:
            self.log.wafers[-1] |= got

    # -- parts

    def _site(self, head: int, site: int) -> tuple[int, int] | None:
        return (head, site) if self.strict else None

    def _name(self) -> str:
        return f"{self.log.lot.get('lot_id', '')}_{self.wafer}_{self.counter}"

    def pir(self, b: Body) -> None:
        site = self._site(b.u1(), b.u1())
        self.counter += 1
        self.part[site], self.efuses[site] = self._name(), []

    def prr(self, b: Body) -> None:
        head, place, flag, tests, hard = b.u1(), b.u1(), b.u1(), b.u2(), b.u2()
        soft, x, y = b.opt("u2", 0), b.opt("i2", -32768), b.opt("i2", -32768)
        time = b.opt("u4", 0)
        b.opt("cn")
        code = b.opt("cn", "")
        site = self._site(head, place)
        part = self.part.get(site, self._name()) if self.strict else self._name()
        self.log.parts.append({
            "record_no": self.no, "wafer_id": self.wafer, "part_id": part, "part_txt": code, "head_num": head, "site_num": place, "x_coord": x, "y_coord": y,
            "hard_bin": hard, "soft_bin": soft, "passed": not flag & 0x08, "test_count": tests, "test_time": time,
        })
        for i, e in enumerate(self.efuses.pop(site, [])):
            self.log.chips.append({"record_no": self.no, "wafer_id": self.wafer, "part_id": part, "part_txt": code, "chip_index": i, "efuse": e})

    # -- measurements

    def _row(self, head: int, place: int, test: int, result: float | None, flag: int, pin: int | None = None) -> None:
        part = self.part.get(self._site(head, place), "")
        self.log.rows.append({"record_no": self.measured, "wafer_id": self.wafer, "part_id": part, "test_num": test, "result": result, "passed": not flag & 0x80, "pin_num": pin, "pin_name": self.log.pins.get(pin) if pin is not None else None})
        self.measured += 1

    def _test(self, num: int, kind: str, name: str = "", lo: float | None = None, hi: float | None = None, units: str = "") -> None:
        self.log.tests.setdefault(num, {"test_name": name, "rec_type": kind, "lo_limit": lo, "hi_limit": hi, "units": units})

    def ptr(self, b: Body) -> None:
        size = min(b.end, len(b.data)) - b.at
        if size < 8:
            b.at = b.end
            return
        num, head, place, flag, _ = b.u4(), b.u1(), b.u1(), b.u1(), b.u1()
        result = b.r4() if b.at + 4 <= b.end else None
        name = ""
        if b.more():
            n = b.u1()
            if n and b.at + n <= b.end:
                name = text(b.data[b.at : b.at + n])
                b.at += n
        if b.more():
            n = b.u1()  # the alarm, which is not kept
            b.at += n
        option = b.data[b.at] if b.at < min(b.end, len(b.data)) else 0
        b.at += 4
        lo = b.r4() if b.at + 4 <= b.end else None
        hi = b.r4() if b.at + 4 <= b.end else None
        units = ""
        if b.more():
            n = b.u1()
            if n and b.at + n <= b.end:
                units = text(b.data[b.at : b.at + n])
        b.at = b.end
        if self.strict:
            lo = None if option & 0x50 else lo
            hi = None if option & 0xA0 else hi
        self._test(num, "PTR", name, lo, hi, units)
        self._row(head, place, num, result, flag)

    def ftr(self, b: Body) -> None:
        if min(b.end, len(b.data)) - b.at < 7:
            b.at = b.end
            return
        num, head, place, flag = b.u4(), b.u1(), b.u1(), b.u1()
        self._test(num, "FTR")
        self._row(head, place, num, None, flag)

    def mpr(self, b: Body) -> None:
        num, head, place, flag, _ = b.u4(), b.u1(), b.u1(), b.u1(), b.u1()
        states, count = b.opt("u2", 0), b.opt("u2", 0)
        for _ in range((states + 1) // 2):
            if not b.more():
                break
            b.u1()
        results = []
        for _ in range(count):
            if not b.more():
                break
            results.append(b.r4())
        name = b.opt("cn", "")
        b.opt("cn")
        option = b.opt("u1", 0)
        for _ in range(3):
            b.opt("u1")
        lo, hi = b.opt("r4"), b.opt("r4")
        b.opt("r4")
        b.opt("r4")
        pins = []
        for _ in range(states):
            if not b.more():
                break
            pins.append(b.u2())
        units = b.opt("cn", "")
        if self.strict:
            lo = None if option & 0x50 else lo
            hi = None if option & 0xA0 else hi
        self._test(num, "MPR", name, lo, hi, units)
        for i in range(max(len(results), len(pins), 1)):
            self._row(head, place, num, results[i] if i < len(results) else None, flag, pins[i] if i < len(pins) else None)

    def gdr(self, b: Body) -> None:
        b.u2()
        size = {1: 1, 2: 2, 3: 4, 4: 1, 5: 2, 6: 4, 7: 4, 8: 8, 13: 1}
        found = []
        while b.more():
            code = b.u1()
            if code == 0:
                continue
            if code in size:
                b.at += size[code]
            elif code == 10:
                found.append(b.cn())
            elif code == 11:
                n = b.u1()
                b.at += n
            elif code == 12:
                n = b.u2()
                b.at += (n + 7) // 8
            else:
                break
        i = 0
        while i + 1 < len(found):
            if found[i] in CHIP_KEYS:
                # Logs with one part at a time name no site; with several, the last begun part is meant.
                site = None if not self.strict else next(reversed(self.efuses), None)
                self.efuses.setdefault(site, []).append(found[i + 1])
                i += 1
            i += 1


def unpacked(data: bytes) -> bytes:
    """The log's bytes; a gzip file is unpacked, a damaged one raises ``ValueError``."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"damaged gzip: {e}") from e


def rows_of(file: str, data: bytes, strict: bool = False, hold: int = BATCH) -> Iterator[dict]:
    """All rows of one log: measurements, wafers, parts, chips, and its lot at the end."""
    walker, place = Walker(strict), {}
    log, seen, lot = walker.log, 0, None
    none = {"part_txt": "", "x_coord": -32768, "y_coord": -32768}

    def tests(rows: list[dict]) -> Iterator[dict]:
        nonlocal seen
        for p in log.parts[seen:]:
            place[p["part_id"]] = {k: p[k] for k in ("part_txt", "x_coord", "y_coord")}
        seen = len(log.parts)
        for r in rows:
            yield lot | {"kind": "test"} | r | place.get(r["part_id"], none) | log.tests[r["test_num"]]

    for _ in walker.steps(unpacked(data)):
        if len(log.rows) >= hold and "lot_id" in log.lot:
            lot = {"file": file, "lot_id": log.lot["lot_id"]}
            yield from tests(walker.finished())
    if lot is not None and lot["lot_id"] != log.lot["lot_id"]:
        raise ValueError("the log names another lot after its measurements")
    lot = {"file": file, "lot_id": log.lot.get("lot_id", "")}
    yield from tests(log.rows)
    for i, w in enumerate(log.wafers):
        yield lot | {"kind": "wafer", "record_no": i} | w
    for p in log.parts:
        yield lot | {"kind": "part"} | p
    for c in log.chips:
        yield lot | {"kind": "chip"} | c
    yield lot | {"kind": "lot", "record_no": 0} | log.lot


def batches(rows: Iterator[dict], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)


class TooLong(BaseException):
    """A log takes too long; no damaged record, which the walk would skip."""


@contextlib.contextmanager
def _within(seconds: float | None) -> Iterator[None]:
    """Raise TooLong in the block after so many seconds; only a process's main thread can."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TooLong(f"not read within {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _timed(found: Iterator, seconds: float | None) -> Iterator:
    """``found``, which may take so many seconds in all; what is done with it does not count."""
    left = seconds
    while True:
        began = time.monotonic()
        with _within(left):
            one = next(found, None)
        if one is None:
            return
        if left:
            left = max(1e-3, left - (time.monotonic() - began))
        yield one


def _parse(it: Iterator[pa.RecordBatch], strict: bool, timeout: float | None) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                yield from _timed(batches(rows_of(file, data.as_py(), strict)), timeout)
            except (ValueError, TooLong) as e:
                yield pa.RecordBatch.from_pylist([{"file": file, "kind": "bad", "error": str(e)}], schema=ARROW)


def parse_files(files: DataFrame, strict: bool = False, timeout: float | None = None) -> DataFrame:
    """Rows of ``files`` (path, content), such as the binaryFile source gives, streaming or not.
    A log that is not read within ``timeout`` seconds gives a row of kind ``bad`` and no row of its lot."""
    return files.select("path", "content").mapInArrow(lambda it: _parse(it, strict, timeout), SCHEMA)


def read_logs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rows of all logs under ``path``; a damaged file gives one row of kind ``bad``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_files(files, strict)


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.strict = options["path"], str(options.get("strict", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        import os

        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(d, f)) for d, _, names in sorted(os.walk(self.path)) for f in sorted(names)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            data = f.read()
        try:
            yield from batches(rows_of(partition.path, data, self.strict))
        except ValueError as e:
            yield pa.RecordBatch.from_pylist([{"file": partition.path, "kind": "bad", "error": str(e)}], schema=ARROW)


class TestLog(DataSource):
    """``spark.dataSource.register(TestLog)``, then ``spark.read.format("testlog").load(path)``."""

    __test__ = False

    @classmethod
    def name(cls) -> str:
        return "testlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)
