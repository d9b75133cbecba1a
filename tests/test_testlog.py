import gzip

import pytest

from silicore.sources.logwriter import Writer, final_test, wafer_test
from silicore.sources.testlog import TestLog, read_logs, rows_of


def parse(data, strict=False, kind=None):
    out = list(rows_of("f", data, strict))
    return [r for r in out if r["kind"] == kind] if kind else out


def test_wafer_log():
    data = wafer_test("LOT1", wafers=2, parts=3, fail=(1,))
    lot = parse(data, kind="lot")[0]
    assert (lot["lot_id"], lot["test_code"], lot["start_t"], lot["finish_t"]) == ("LOT1", "CP11", 1_700_000_000, 1_700_003_600)
    wafers = parse(data, kind="wafer")
    assert [(w["wafer_id"], w["part_count"], w["good_count"]) for w in wafers] == [("W1", 3, 2), ("W2", 3, 2)]
    parts = parse(data, kind="part")
    assert [p["part_id"] for p in parts[:3]] == ["LOT1_W1_1", "LOT1_W1_2", "LOT1_W1_3"]
    assert [p["passed"] for p in parts] == [True, False, True] * 2
    tests = parse(data, kind="test")
    assert tests[1]["passed"] is False and tests[1]["test_name"] == "Vth_N" and tests[1]["x_coord"] == 1
    assert tests[0]["result"] == 0.5 and abs(tests[0]["lo_limit"] - 0.3) < 1e-6


@pytest.mark.parametrize("big", [False, True])
def test_every_record(big):
    w = Writer(big)
    w.mir("L", code="CP1")
    w.bin("hard", 1, 5, "PASS")
    w.bin("soft", 1, 5, "PASS")
    w.pmr(1, "CH1", "PHY1", "LOG1")
    w.pmr(2, "CH2", "PHY2")
    w.pmr(3, "CH3")
    w.wir("W1")
    w.record(99, 1, b"unknown")
    w.record(1, 30, b"\1\2\3")
    w.out += w.pack("H", 0) + b"\0\0"
    w.pir()
    w.ptr(1, 0.25, "P", 0, 1)
    w.ftr(2, fail=True)
    w.mpr(3, [0.1, 0.2, 0.3], [1, 2, 3], "M")
    w.mpr(4, [], [])
    w.mpr(5, [0.5], [2, 3])
    w.gdr((1, 7), (2, 7), (3, 7), (4, -1), (5, -1), (6, -1), (7, 1.5), (8, 2.5), (11, b"ab"), (12, b"\1\2"), (13, 3), (0, None), (10, "EN-SO-CHIPID_R"), (10, "0b" + "1" * 64), (99, None))
    w.prr(3, -4, False, 2, 7, "TXT")
    w.wrr(1, 0)
    w.mrr(1_700_009_999)
    tests = parse(w.bytes(), kind="test")
    assert [(t["test_num"], t["rec_type"]) for t in tests] == [(1, "PTR"), (2, "FTR"), (3, "MPR"), (3, "MPR"), (3, "MPR"), (4, "MPR"), (5, "MPR"), (5, "MPR")]
    assert [t["pin_name"] for t in tests[2:5]] == ["LOG1", "PHY2", "CH3"]
    assert tests[1]["result"] is None and tests[1]["test_name"] == "" and tests[1]["passed"] is False
    assert tests[5]["result"] is None and tests[5]["pin_num"] is None
    assert (tests[6]["result"], tests[7]["result"], tests[7]["pin_num"]) == (0.5, None, 3)
    assert {(t["x_coord"], t["y_coord"], t["part_txt"]) for t in tests} == {(3, -4, "TXT")}
    chips = parse(w.bytes(), kind="chip")
    assert len(chips) == 1 and chips[0]["efuse"] == "0b" + "1" * 64
    assert parse(w.bytes(), kind="lot")[0]["finish_t"] == 1_700_009_999


def test_first_definition_of_a_test_counts():
    w = Writer()
    w.mir("L")
    w.pir()
    w.ptr(1, 0.5, "A", 0, 1)
    w.ptr(1, 0.6, "B", 5, 6)
    w.prr(0, 0)
    assert {(t["test_name"], t["hi_limit"]) for t in parse(w.bytes(), kind="test")} == {("A", 1.0)}


def test_sites_interleave_and_limit_flags():
    w = Writer()
    w.mir("L")
    w.pir(site=1)
    w.pir(site=2)
    w.ptr(1, 0.1, "A", site=1, option=0x50)
    w.ptr(1, 0.2, "A", site=2)
    w.prr(1, 1, site=1)
    w.prr(2, 2, site=2)
    loose = parse(w.bytes(), kind="test")
    assert len({t["part_id"] for t in loose}) == 1
    strict = parse(w.bytes(), True, "test")
    assert [(t["x_coord"], t["result"] < 0.15) for t in strict] == [(1, True), (2, False)]
    assert strict[0]["lo_limit"] is None and loose[0]["lo_limit"] == 0.0


@pytest.mark.parametrize("cut", [1, 3, 10])
def test_truncated_tail(cut):
    data = wafer_test("L", parts=3)
    whole, short = parse(data), parse(data[:-cut])
    assert 0 < len(short) <= len(whole)
    assert len([r for r in short if r["kind"] == "part"]) == 3


def test_empty_and_foreign_bytes():
    assert [r["kind"] for r in parse(b"")] == ["lot"]
    assert parse(b"hello world, this is not a log", kind="test") == []


def test_read_logs_and_data_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(wafer_test("A", parts=5))
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(final_test("B", 3, (1,))))
    (tmp_path / "c.log.gz").write_bytes(gzip.compress(final_test("C", 3))[:-12])
    df = read_logs(spark, str(tmp_path))
    kinds = {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}
    assert kinds == {"lot": 2, "wafer": 1, "part": 8, "test": 8, "chip": 6, "bad": 1}
    spark.dataSource.register(TestLog)
    other = spark.read.format("testlog").load(str(tmp_path))
    assert {r.kind: r["count"] for r in other.groupBy("kind").count().collect()} == kinds


def test_measurements_leave_during_the_walk():
    """However few are held, the rows are those of a walk that holds all."""
    from silicore.sources.testlog import Walker, rows_of

    w = Writer()
    w.mir("L")
    for k in range(3):
        w.wir(f"W{k}")
        for i in range(20):
            for site in (0, 1):
                w.pir(site)
            for site in (1, 0):
                w.ptr(10 + site, i / 10, "a", site=site)
            w.mpr(20, [1.0, 2.0], [3, 4], "m")
            for site in (0, 1):
                w.prr(i, k, site=site, text=f"{i}.{site}")
            w.ptr(12, 9.0, "late", site=1)
    w.mrr(5)
    key = lambda rows: sorted(repr(sorted(r.items(), key=lambda x: x[0])) for r in rows)
    for strict in (False, True):
        whole = list(rows_of("f", w.bytes(), strict))
        assert key(rows_of("f", w.bytes(), strict, hold=1)) == key(whole) and whole[-1]["kind"] == "lot"
        walker, most = Walker(strict), 0
        for _ in walker.steps(w.bytes()):
            walker.finished()
            most = max(most, len(walker.log.rows))
        assert most < 20 < len([r for r in whole if r["kind"] == "test"])
