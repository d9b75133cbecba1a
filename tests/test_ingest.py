import gzip
import json
import threading

import pytest
from pyspark.sql import functions as F

from silicore.functions.expr import category, decode_efuse, path_safe, revision
from silicore.operators import analysis as A
from silicore.operators import recipes as R
from silicore.operators.retest import demote, verify_flags, with_retest_flag
from silicore.serving import export, gate
from silicore.serving.client import Client, QueryError
from silicore.serving.server import Service, serve
from silicore.session import Session
from silicore.sources import config
from silicore.sources.ftp import CorruptDownload, Fetcher, History, fetch_new
from silicore.sources.logwriter import final_test, wafer_test
from silicore.sources.store import Store
from silicore.streaming.ingest import Ingest


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    logs = base / "logs"
    logs.mkdir()
    (logs / "LOT1_x#1.log").write_bytes(wafer_test("LOT1", wafers=2, parts=4, fail=(1, 2)))
    (logs / "LOT1_x#2.log").write_bytes(wafer_test("LOT1", wafers=1, parts=2, start=1_700_100_000, shift=0.1))
    (logs / "FT9_x#1.log").write_bytes(final_test("FT9", 3, (2,)))
    (logs / "bad.gz").write_bytes(gzip.compress(b"x" * 1000)[:-9])
    s = Store(spark, str(base / "store"), {"PROD": (6, 200)})
    done = Ingest(s, "PROD").directory(str(logs))
    assert {r.status: r["count"] for r in done.groupBy("status").count().collect()} == {"ok": 3, "bad": 1}
    return s


def test_runs_flags_and_views(store):
    m = store.model()
    runs = {(r.wafer_id, r.retest_num): r["count"] for r in m.parts.where("lot_id = 'LOT1'").groupBy("wafer_id", "retest_num").count().collect()}
    assert runs == {("W1", 0): 4, ("W1", 1): 2, ("W2", 0): 4}
    flags = {(r.wafer_id, r.x_coord, r.retest_num): r.retest_flag for r in m.test_data.where("lot_id = 'LOT1'").collect()}
    assert flags[("W1", 0, 0)] == 1 and flags[("W1", 0, 1)] == 0 and flags[("W1", 3, 0)] == 0
    y = {r.wafer_id: r for r in m.wafer_yield_final.where("lot_id = 'LOT1'").collect()}
    assert (y["W1"].probed, y["W1"].good, y["W1"].total, y["W1"].unprobed) == (4, 3, 6, 2)
    assert (y["W2"].good, y["W2"].yield_pct) == (2, 33.33)
    ft = m.wafer_yield_final.where("lot_id = 'FT9'").first()
    assert (ft.wafer_id, ft.total, ft.good) == ("", 3, 2)
    assert m.chipid.count() == 6 and m.chipid_final.count() == 6
    assert m.lots.count() == 2
    assert all(r.null_flags == r.orphaned_keys == r.inconsistent_runs == r.dup_current == 0 for r in verify_flags(m.test_data).collect())


def test_manifest_skips_what_is_done(store, tmp_path):
    logs = store.path.rsplit("/", 1)[0] + "/logs"
    assert Ingest(store, "PROD").directory(logs).count() == 0
    assert Ingest(store, "PROD").failures().count() == 1
    assert Ingest(store, "PROD").directory(logs, retry_bad=True).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    one, two = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    files = [wafer_test("A", parts=4, fail=(0,)), wafer_test("A", parts=3, start=1_700_200_000), wafer_test("A", parts=1, start=1_700_300_000), wafer_test("B", parts=2)]
    for i, f in enumerate(files):
        (logs / f"A_l#{i}.log").write_bytes(f)
        Ingest(one, "P").stream(str(logs), str(tmp_path / "ck"))
    Ingest(two, "P").directory(str(logs))
    cols = ["lot_id", "wafer_id", "x_coord", "retest_num", "exec_seq", "retest_flag", "result"]
    a, b = (sorted(map(tuple, s.model().test_data.select(*cols).collect())) for s in (one, two))
    assert a == b and len(a) == 10
    assert max(r[5] for r in a) == 2


def snapshot(store):
    m = store.model()
    return {n: sorted((tuple(map(str, r)) for r in t.collect())) for n in ("lots", "wafers", "parts", "test_data", "chipid") if (t := getattr(m, n)) is not None}


def test_a_broken_batch_counts_once(spark, tmp_path, monkeypatch):
    """A write in the middle, the last and the manifest's write fail; the run that follows gives the tables of an undisturbed one."""
    logs = [tmp_path / "one", tmp_path / "two"]
    for d in logs:
        d.mkdir()
    (logs[0] / "A_l#1.log").write_bytes(wafer_test("A", wafers=2, parts=4, fail=(1,)))
    (logs[0] / "F_l#1.log").write_bytes(final_test("F", 2))
    (logs[1] / "A_l#2.log").write_bytes(wafer_test("A", parts=3, start=1_700_200_000))
    clean = Store(spark, str(tmp_path / "clean"))
    for d in logs:
        Ingest(clean, "P").directory(str(d))
    want = snapshot(clean)
    assert {r[-4] for r in want["parts"]} and len(want["test_data"]) == 13
    put = Store.replace_lots
    for broken in ("parts", "lots", "manifest"):
        store = Store(spark, str(tmp_path / f"broken-{broken}"))
        Ingest(store, "P").directory(str(logs[0]))
        with monkeypatch.context() as patch:
            if broken == "manifest":
                patch.setattr(Ingest, "_manifest", property(lambda self: self.store.path + "/nowhere:\0"))
                patch.setattr(Ingest, "manifest", lambda self: self.store.spark.read.parquet(self.store.path + "/_manifest", recursiveFileLookup=True))
            else:
                patch.setattr(Store, "replace_lots", lambda self, name, df: 1 / 0 if name == broken else put(self, name, df))
            with pytest.raises(Exception):
                Ingest(store, "P").directory(str(logs[1]))
        assert Ingest(store, "P").directory(str(logs[1])).count() == 0, broken
        assert snapshot(store) == want, broken
        Ingest(store, "P").recover()
        assert snapshot(store) == want and Ingest(store, "P").manifest().count() == 3


def test_a_batch_that_was_not_ready_is_forgotten(spark, tmp_path, monkeypatch):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/A_l#1.log").write_bytes(wafer_test("A", parts=4))
    store = Store(spark, str(tmp_path / "store"))
    with monkeypatch.context() as patch:
        patch.setattr(Ingest, "_put", lambda self, stage: 1 / 0)
        patch.setattr("silicore.streaming.ingest.with_retest_flag", lambda df: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            Ingest(store, "P").directory(str(tmp_path / "logs"))
    assert not store.has("parts")
    assert Ingest(store, "P").directory(str(tmp_path / "logs")).count() == 1
    assert store.model().parts.agg(F.max("retest_num"), F.count("*")).first()[:] == (0, 4)


def test_stream_replay_counts_once(spark, tmp_path):
    """A batch that is handed over again, as after a crash, changes nothing."""
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "A_l#1.log").write_bytes(wafer_test("A", parts=4))
    store = Store(spark, str(tmp_path / "store"))
    Ingest(store, "P").stream(str(logs), str(tmp_path / "ck1"))
    want = snapshot(store)
    Ingest(store, "P").stream(str(logs), str(tmp_path / "ck2"))
    assert snapshot(store) == want and len(want["parts"]) == 4


def test_keys_survive_as_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    keys = ["L1", "", None, "_x", "__y", "_null", "a/b:c*", "007", " pad ", "1e5"]
    df = spark.createDataFrame([(k, "P", "CP", None) for k in keys], "lot_id string, product string, test_category string, sub_process string")
    store.replace_lots("lots", df)
    assert sorted(r.lot_id or repr(r.lot_id) for r in store.model().lots.collect()) == sorted(k or repr(k) for k in keys)
    assert [store.model().lots.where(F.col("lot_id") == k).count() for k in keys if k is not None] == [1] * 9


def partition_filters(df) -> list[str]:
    import re

    return re.findall(r"PartitionFilters: \[(.*?)\](?:, (?:PushedFilters|Read)|\n|$)", df._jdf.queryExecution().executedPlan().toString())


def test_reports_prune_lots_and_products(store, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    m = store.model()
    for df in (R.r5_3(m, "LOT1"), R.r3_1(m, "LOT1"), A.wafer_yield(m, "LOT1"), R.r8_1(m, "LOT1"), A.test_stats_by_lot(m, ["LOT1", "FT9"])):
        found = partition_filters(df)
        assert found and all("p_lot" in f for f in found if f), found
        assert any("LOT1" in f for f in found)
    assert any("p_product" in f for f in partition_filters(R.r2_1(m, "PROD", "CP1")))
    touched = spark.createDataFrame([("PROD", "CP", "CP11", "LOT1")], "product string, test_category string, sub_process string, lot_id string")
    for name in ("parts", "test_data"):
        df = Ingest(store)._lots(name, touched)
        assert all("p_lot" in f for f in partition_filters(df)) and df.count() > 0


def test_known_logs_are_not_opened(store, spark, monkeypatch):
    logs = store.path.rsplit("/", 1)[0] + "/logs"
    monkeypatch.setattr(Ingest, "batch", lambda self, files: 1 / 0)
    assert Ingest(store, "PROD").directory(logs).count() == 0


def test_demotion_equals_rank(spark):
    schema = "lot_id string, wafer_id string, x_coord bigint, y_coord bigint, part_txt string, test_num bigint, pin_num bigint, retest_num bigint"
    runs = [[("L", "W", x, 0, "", t, p) for x in xs for t, p in ((1, None), (2, 3))] for xs in ((0, 1, 2), (1,), (1, 2), (5,))]
    now = None
    for k, run in enumerate(runs):
        fresh = spark.createDataFrame([(*r, k) for r in run], schema).withColumn("retest_flag", F.lit(0).cast("bigint"))
        now = fresh if now is None else demote(now, fresh).unionByName(fresh)
    every = spark.createDataFrame([(*r, k) for k, run in enumerate(runs) for r in run], schema)
    assert sorted(map(tuple, now.fillna(-1).collect())) == sorted(map(tuple, with_retest_flag(every).fillna(-1).collect()))


def test_decode_vectors(spark):
    known = {0x13998DC75193D350: ("E6B156", 11, 99, 115), 0x139189C75193D350: ("E6B156", 11, 98, 114), 0x134191A75193D34C: ("E6B155", 10, 100, 104)}
    df = spark.createDataFrame([("0b" + format(k, "064b"),) for k in known] + [("0b01",), (None,), ("x" * 64,)], "v string")
    out = df.select(*[c.alias(n) for n, c in decode_efuse("v").items()]).collect()
    assert [(r.origin_lot, r.origin_wafer, r.origin_x, r.origin_y) for r in out[:3]] == list(known.values())
    assert all(r.origin_fab == "TSMC1" for r in out[:3])
    assert [(r.valid, r.origin_lot) for r in out[3:]] == [(False, None)] * 3 and out[3].efuse_raw == "0b01"


def test_text_helpers(spark):
    row = spark.sql("SELECT 'a_Rev04_b.log' f, 'pt1' c, ' a/b:c* ' p").select(revision("f"), category("c"), path_safe("p")).first()
    assert tuple(row) == ("Rev04", "CP", "a_b_c_")


def test_session_export_and_pivot(store, tmp_path):
    with Session(store) as s:
        assert s.q("SELECT count(*) AS n FROM parts_final WHERE lot_id = ?", ["LOT1"]).first().n == 8
        assert s.q("SELECT count(*) AS n, '$1' AS t FROM parts_final WHERE lot_id = $1 AND $1 <> $2 -- $9", ["LOT1", "x"]).first()[:] == (8, "$1")
        assert export.to_file(s.q("SELECT lot_id, retest_num, passed FROM parts"), str(tmp_path / "p.parquet"), "parquet") == 13
        assert s.spark.read.parquet(str(tmp_path / "p.parquet")).where("lot_id = 'FT9'").count() == 3
        assert s.use("parts", "LOT1").count() == 10 and s.kept[0].is_cached
    assert not s.kept[0].is_cached
    with Session(store) as s:
        assert [r.lot_id for r in s.lots("PROD", "CP").collect()] == ["LOT1"]
        assert A.lot_summary(s.model, "LOT1").first().total_parts == 12
        wide = R.lot_pivot(s.model, ["LOT1"])
        assert wide.columns[-1] == "Vth_N" and wide.count() == 8
        n = export.to_file(s.q("SELECT lot_id, retest_num FROM parts"), str(tmp_path / "p.csv"))
        assert n == 13 and (tmp_path / "p.csv").read_text().count("\n") == 14


REFUSED = [
    "DROP VIEW parts", "SELECT 1; SELECT 2", "INSERT INTO parts VALUES (1)", "SET spark.x = 1", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM other", "", "SELECT * FROM range(5)",
    "SELECT TRANSFORM(lot_id) USING 'cat' AS (x) FROM parts", "WITH a AS (SELECT reflect('java.lang.System', 'exit', 1)) SELECT * FROM a", "SELECT * FROM parts WHERE lot_id IN (SELECT * FROM text.`/etc/passwd`)", "SHOW TABLES", "CREATE TABLE t AS SELECT 1",
    "SELECT (SELECT reflect('a', 'b')) FROM parts", "EXPLAIN SELECT 1",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_gate_refuses(store, sql):
    with Session(store) as s, pytest.raises(gate.Refused):
        gate.run(s.spark, sql, set(s.views))


def test_gate_lets_queries_through(store):
    with Session(store) as s:
        sql = "WITH f AS (SELECT * FROM parts_final WHERE NOT passed) SELECT lot_id, count(*) AS n, max((SELECT count(*) FROM lots)) AS k FROM f WHERE EXISTS (SELECT 1 FROM lots l WHERE l.lot_id = f.lot_id) GROUP BY lot_id HAVING count(*) > 0 ORDER BY 1;"
        assert [tuple(r) for r in gate.run(s.spark, sql, set(s.views)).collect()] == [("FT9", 1, 2), ("LOT1", 3, 2)]


def test_server_and_client(store):
    server = serve(Service(store.spark, lambda s: Store(s, store.path, store.gross_die).model(), max_rows=5), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = Client(f"http://127.0.0.1:{server.server_address[1]}")
        df = c.q("SELECT * FROM parts")
        assert len(df) == 5 and df.attrs["truncated"]
        assert len(c.q("SELECT lot_id FROM lots")) == 2
        assert "wafer_yield_final" in c.views()
        with pytest.raises(QueryError, match="no view"):
            c.q("SELECT * FROM nothing")
        assert b"ok" in c._ask("/health")
    finally:
        server.shutdown()


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SECRET", "s3")
    f = tmp_path / "c.yaml"
    f.write_text("ftp:\n  host: h\n  password: ${SECRET}\nstorage:\n  data_dir: /d # x\nproducts:\n  A:\n    gross_die: 10\n  B:\n    gross_die: 20\n    gd_fail_bin: 7\n  C:\n    gd_fail_bin: 1\nfilters:\n  - product: A\n    test_types: [CP]\nexclude:\n  - \"*debug*\"\n")
    s = config.load(str(f)).for_env("t")
    assert (s.ftp["host"], s.ftp["password"], s.ftp["port"], s.data_dir) == ("h", "s3", 21, "/d-t")
    assert s.gross_die == {"A": (10, 200), "B": (20, 7)}
    assert s.wanted("A", "CP1") and not s.wanted("A", "FT1") and not s.wanted("B", "CP1")
    assert s.excluded("x_DEBUG_1.log") and config.load(str(tmp_path / "none")).max_rows == 10_000


class FakeFtp:
    tree = {"": ["P"], "/P": ["CP1", "XX"], "/P/CP1": ["L1"], "/P/CP1/L1": ["a.std.gz", "b.std", "c.txt", "d.std.gz"]}
    files = {"a.std.gz": gzip.compress(b"AAA"), "b.std": b"BBB", "d.std.gz": gzip.compress(b"D" * 500)[:-6]}

    def connect(self, *_): ...
    def login(self, *_): ...
    def close(self): ...

    def nlst(self, path):
        return [f"{path.rstrip('/')}/{n}" for n in self.tree[path.rstrip("/")]]

    def retrbinary(self, cmd, put):
        put(self.files[cmd.rsplit("/", 1)[1]])


def test_fetch(tmp_path):
    s = config.Settings()
    h = History(str(tmp_path / "h.json"))
    with Fetcher(s, FakeFtp) as f:
        got = fetch_new(f, h, str(tmp_path))
        assert [len(got[k]) for k in ("fetched", "corrupt", "failed")] == [2, 1, 0]
        assert (tmp_path / "P/CP1/a.std").read_bytes() == b"AAA" and not list(tmp_path.rglob("*.part"))
        assert fetch_new(f, History(h.path), str(tmp_path))["fetched"] == []
        assert fetch_new(f, h, str(tmp_path), retry_corrupt=True)["corrupt"] == ["/P/CP1/L1/d.std.gz"]
        with pytest.raises(CorruptDownload):
            f.fetch("/P/CP1/L1/d.std.gz", str(tmp_path))
    assert json.loads((tmp_path / "h.json").read_text())["corrupt"] and len(h.pending()) == 2


def test_fetch_command(spark, tmp_path, monkeypatch):
    from silicore import cli
    from silicore.sources import ftp

    class Server(FakeFtp):
        tree = {"": ["P"], "/P": ["CP1"], "/P/CP1": ["L1"], "/P/CP1/L1": ["a#1.std.gz", "b#2.std"]}
        files = {"a#1.std.gz": gzip.compress(wafer_test("L1")), "b#2.std": gzip.compress(wafer_test("L1"))[:-20]}

    monkeypatch.setattr(ftp.Fetcher.__init__, "__defaults__", (Server,))
    f = tmp_path / "c.yaml"
    f.write_text(f"storage:\n  data_dir: {tmp_path}/store\n  download_dir: {tmp_path}/dl\n")
    assert cli.main(["-c", str(f), "fetch"], spark) == 1
    h = History(f"{tmp_path}/dl/history.json")
    assert not h.pending() and list(h.state["corrupt"]) == ["/P/CP1/L1/b#2.std"]
    assert (tmp_path / "dl/_corrupt/b#2.std").exists()
    assert Store(spark, f"{tmp_path}/store").model().parts.count() == 4
    assert not list(tmp_path.rglob("a#1.std"))
    assert cli.main(["-c", str(f), "fetch"], spark) == 0
    assert cli.main(["-c", str(f), "fetch", "-t", "FT", "-f"], spark) == 0 and not list(tmp_path.rglob("a#1.std"))
    assert cli.main(["-c", str(f), "fetch", "--no-cleanup", "-f", "--no-ingest"], spark) == 0 and list(tmp_path.rglob("a#1.std"))
    assert cli.main(["-c", str(f), "fetch", "--reingest", "--timeout", "60", "-w", "4", "-v"], spark) == 0
    assert Store(spark, f"{tmp_path}/store").model().parts.agg(F.max("retest_num")).first()[0] == 1


def test_a_log_that_takes_too_long_is_bad(spark, tmp_path, monkeypatch):
    import time

    from silicore.sources import testlog

    monkeypatch.setattr(testlog.Walker, "pir", lambda self, b: time.sleep(5))
    with pytest.raises(testlog.TooLong), testlog._within(0.2):
        list(testlog.rows_of("f", wafer_test("A")))
    began = time.time()
    (tmp_path / "a#1.log").write_bytes(wafer_test("A", parts=30_000))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = testlog.parse_files(files, timeout=0.001).collect()
    assert [r.kind for r in rows] == ["bad"] and "0.001 seconds" in rows[0].error and time.time() - began < 60


def test_a_replacement_waits_for_readers(tmp_path, monkeypatch):
    import os

    from silicore.sources import ftp

    calls, put = [], os.replace
    monkeypatch.setattr(ftp.time, "sleep", calls.append)
    monkeypatch.setattr(ftp.os, "replace", lambda a, b: put(a, b) if len(calls) > 1 else (_ for _ in ()).throw(PermissionError()))
    ftp.write_json(tmp_path / "h.json", {"a": 1})
    assert calls == [0.05, 0.1] and ftp.read_json(tmp_path / "h.json", {}) == {"a": 1}


def test_diagnose():
    from silicore.sources.diagnose import compare_downloads, gzip_report

    a = gzip.compress(b"x" * 5000) + gzip.compress(b"y" * 10)
    assert [m.plain for m in gzip_report(a).members] == [5000, 10] and gzip_report(a).verdict == "ok"
    assert gzip_report(a[:-3]).verdict == "truncated" and gzip_report(b"abc").verdict == "not gzip"
    broken = bytearray(a)
    broken[20] ^= 0xFF
    assert gzip_report(bytes(broken)).verdict in ("damaged", "truncated")
    assert compare_downloads(a, a) == "both downloads are whole" and "differ" in compare_downloads(a, a[:-3])


def test_cli(store, spark, tmp_path, capsys, monkeypatch):
    from silicore import cli

    f = tmp_path / "c.yaml"
    f.write_text(f"storage:\n  data_dir: {store.path}\n")
    assert cli.main(["-c", str(f), "db", "verify-flags"], spark) == 0
    assert cli.main(["-c", str(f), "analyze", "yield", "LOT1"], spark) == 0
    assert cli.main(["-c", str(f), "export", "lot", "LOT1", str(tmp_path / "o.csv"), "--no-pivot"], spark) == 0
    assert "LOT1" in (tmp_path / "o.csv").read_text() and "W1" in capsys.readouterr().out
    assert cli.main(["-c", str(f), "db", "query", "SELECT * FROM parts", "-n", "3"], spark) == 0 and "3 rows, and more" in capsys.readouterr().out
    assert cli.main(["-c", str(f), "db", "query", "SELECT * FROM parts", "--limit", "0"], spark) == 0 and "13 rows\n" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", ["SELECT nothing;\n", "SELECT lot_id\n", "FROM lots;\n", "quit;\n"])
    assert cli.main(["-c", str(f), "db", "shell"], spark) == 0
    said = capsys.readouterr()
    assert "FT9" in said.out and "nothing" in said.err
