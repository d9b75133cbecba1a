"""Plans that must hold at size: filters reach the scan, no comparison of all pairs, partial windows."""

import re

from silicore.operators import analysis as A
from silicore.operators import recipes as R
from silicore.operators import retest
from silicore.plans.driver_model import load
from silicore.plans.views import Model
from silicore.sources.schemas import stored

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def written(spark, tmp_path) -> Model:
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    out = {}
    m = load(spark, SF)
    for n in ("lots", "parts", "test_data"):
        df = getattr(m, n)
        cols = [c for c in stored(n).fieldNames() if c in df.columns]
        df.select(*cols).write.parquet(f"{tmp_path}/{n}")
        out[n] = spark.read.parquet(f"{tmp_path}/{n}")
    return Model(**out)


def test_filters_reach_the_scan(spark, tmp_path):
    m = written(spark, tmp_path)
    p = plan(R.r5_1(m, "L0", "T1"))
    assert "EqualTo(retest_flag,0)" in p and "EqualTo(lot_id,L0)" in p and "EqualTo(test_name,T1)" in p
    assert "pin_name" not in p and "Window" not in p
    p = plan(R.r3_1(m, "L0"))
    assert "EqualTo(lot_id,L0)" in p and "WindowGroupLimit" in p


def test_neighbours_are_an_equi_join(spark, tmp_path):
    p = plan(R.r4_4(written(spark, tmp_path), "L0", "W01"))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_reports_of_one_scan(spark, tmp_path):
    m = written(spark, tmp_path)
    measured = lambda df: plan(df).count("EqualTo(retest_flag,0)")
    assert measured(R.r8_2(m, "P0", "CP", "CP1")) == 1 and measured(R.r7_3(m, "L0")) == 1 and measured(A.test_trend(m, "P1", "CP", 2)) == 1
    assert plan(R.r5_3(m, "L0")).count("FileScan") == 1
    assert plan(R.r8_1(m, "L0")).count("FileScan") == 1


def test_trends_keep_their_lots_before_the_window(spark, tmp_path):
    m = written(spark, tmp_path)
    p = A.lot_trend(m, "P0", "CP")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in p and p.index("Window") < p.index("LeftSemi")


def test_a_review_does_not_shuffle_measurements_by_test(spark, tmp_path):
    m = written(spark, tmp_path)
    review = spark.createDataFrame([("1", "0.5", "2.5")], "test_num string, rev_lsl string, rev_usl string")
    p = plan(R.r8_4(m, review, "P0", "CP", "CP1"))
    assert "BroadcastHashJoin [test_num" in p and "hashpartitioning(test_num" in p
    rows = [line for line in p.splitlines() if "SortMergeJoin" in line and "test_num" in line and "LeftOuter" in line]
    assert not rows


def test_flags_are_verified_in_one_shuffle_whose_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    m = written(spark, tmp_path)
    size = sum(f.stat().st_size for f in (tmp_path / "test_data").glob("*.parquet"))
    monkeypatch.setattr(retest, "TASK_BYTES", size // 50)
    df = retest.verify_flags(m.test_data)
    by_key = [line for line in plan(df).splitlines() if "Exchange hashpartitioning(" in line and "test_num" in line]
    assert len(by_key) == 1 and "REPARTITION_BY_NUM" in by_key[0]
    assert 50 <= int(re.search(r", (\d+)\), REPARTITION_BY_NUM", by_key[0])[1]) <= 52
    assert {r.lot_id: r["rows"] for r in df.collect()} == {r.lot_id: r["count"] for r in m.test_data.groupBy("lot_id").count().collect()}


def test_flags_of_rows_from_a_source_of_unknown_size(spark):
    rows = [("L1", "W1", 1, 1, "", 7, None, run, flag) for run, flag in ((0, 1), (0, None), (1, 0), (1, 2), (2, 0))]
    rdd = spark.sparkContext.parallelize(rows, 2)
    df = spark.createDataFrame(rdd, "lot_id string, wafer_id string, x_coord bigint, y_coord bigint, part_txt string, test_num bigint, pin_num bigint, retest_num bigint, retest_flag bigint")
    assert [tuple(r) for r in retest.verify_flags(df).collect()] == [("L1", 5, 1, 0, 1, 1)]
