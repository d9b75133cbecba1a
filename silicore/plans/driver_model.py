"""The driver's star-schema tables as test data: orders are dies, line items measurements.

Lots 0-6 are wafer test, 7-9 final test. Orders of status F are measured twice. Each
packaged part has two chips whose origins point at wafer-test dies. The mapping is one
SQL text that Spark and DuckDB both run, so every report has an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silicore.operators.retest import with_exec_seq, with_retest_flag
from silicore.plans.views import Model, gross_die_table



def C(names: str) -> str:  # noqa: N802
    return ", ".join(names.split())


GROSS = {"P0": (700, 200), "P1": (400, 200)}

PARTS_SQL = f"""
WITH die AS (
  SELECT {C('o_orderkey o_custkey o_orderstatus o_totalprice o_orderkey')} % 10 AS lot_no, CAST(floor(o_orderkey / 10) AS BIGINT) AS d FROM orders
), run AS (
  SELECT *, CAST(0 AS BIGINT) AS retest_num, o_orderstatus <> 'F' AS passed FROM die
  UNION ALL SELECT *, CAST(1 AS BIGINT), o_totalprice > 200000 FROM die WHERE o_orderstatus = 'F'
)
SELECT concat('L', CAST(lot_no AS VARCHAR(9)), '_', CAST(o_orderkey AS VARCHAR(19)), '_', CAST(retest_num AS VARCHAR(9))) AS part_id,
  CASE WHEN lot_no >= 7 THEN concat('BC', CAST(o_orderkey AS VARCHAR(19))) ELSE '' END AS part_txt,
  concat('L', CAST(lot_no AS VARCHAR(9))) AS lot_id,
  CASE WHEN lot_no >= 7 THEN '' ELSE concat('W0', CAST(d % 5 AS VARCHAR(9))) END AS wafer_id,
  CAST(1 AS BIGINT) AS head_num, CAST(o_custkey % 4 AS BIGINT) AS site_num,
  CASE WHEN lot_no >= 7 THEN -32768 ELSE CAST(floor(d / 5) AS BIGINT) % 20 - 10 END AS x_coord,
  CASE WHEN lot_no >= 7 THEN -32768 ELSE CAST(floor(d / 100) AS BIGINT) - 10 END AS y_coord,
  CAST(CASE WHEN passed THEN 1 ELSE 2 END AS BIGINT) AS hard_bin, CASE WHEN passed THEN 1 ELSE 2 + o_custkey % 4 END AS soft_bin,
  passed, CAST(o_custkey % 9 AS BIGINT) AS test_count, CAST(o_custkey % 500 AS BIGINT) AS test_time, retest_num, o_orderkey AS record_no,
  concat('P', CAST(lot_no % 3 AS VARCHAR(9))) AS product, CASE WHEN lot_no >= 7 THEN 'FT' ELSE 'CP' END AS test_category, CASE WHEN lot_no >= 7 THEN 'FT1' ELSE 'CP1' END AS sub_process
FROM run"""

ROWS_SQL = f"""
SELECT {C('p.lot_id p.wafer_id p.part_id p.part_txt p.x_coord p.y_coord')}, CAST(l.l_linenumber AS BIGINT) AS test_num,
  concat(CASE WHEN l.l_linenumber = 3 AND p.lot_id IN ('L2', 'L5') THEN 'U' ELSE 'T' END, CAST(l.l_linenumber AS VARCHAR(9))) AS test_name,
  CASE WHEN l.l_linenumber = 7 THEN 'FTR' WHEN l.l_linenumber IN (5, 6) THEN 'MPR' ELSE 'PTR' END AS rec_type,
  CAST(CASE WHEN l.l_linenumber = 7 THEN NULL ELSE 1000 * l.l_linenumber + CASE WHEN p.lot_id = 'L4' THEN 500 ELSE 0 END END AS DOUBLE) AS lo_limit,
  CAST(CASE WHEN l.l_linenumber = 7 THEN NULL ELSE 90000 - 1000 * l.l_linenumber END AS DOUBLE) AS hi_limit,
  CASE WHEN l.l_linenumber IN (1, 2) THEN 'V' WHEN l.l_linenumber IN (3, 4) THEN 'mA' ELSE 'Ohm' END AS units,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_extendedprice END AS result, CASE WHEN l.l_returnflag = 'R' THEN 'F' ELSE 'P' END AS passed, p.retest_num,
  CASE WHEN l.l_linenumber IN (5, 6) THEN l.l_suppkey % 4 ELSE NULL END AS pin_num, CASE WHEN l.l_linenumber IN (5, 6) THEN concat('PIN', CAST(l.l_suppkey % 4 AS VARCHAR(9))) ELSE NULL END AS pin_name,
  l.l_partkey AS k1, l.l_suppkey AS {C('k2 p.record_no p.product p.test_category p.sub_process')}
FROM lineitem l JOIN m_parts p ON p.record_no = l.l_orderkey
WHERE p.retest_num = 0 OR l.l_linestatus = 'F'"""

LOTS_SQL = """
SELECT concat('L', CAST(o_orderkey % 10 AS VARCHAR(9))) AS lot_id, concat('P', CAST((o_orderkey % 10) % 3 AS VARCHAR(9))) AS product,
  CASE WHEN o_orderkey % 10 >= 7 THEN 'FT' ELSE 'CP' END AS test_category, CASE WHEN o_orderkey % 10 >= 7 THEN 'FT1' ELSE 'CP1' END AS sub_process,
  concat('PT', CAST(o_orderkey % 10 % 3 AS VARCHAR(9))) AS part_type, concat('JOB', CAST(o_orderkey % 10 % 2 AS VARCHAR(9))) AS job_name, concat('Rev0', CAST(o_orderkey % 10 % 4 AS VARCHAR(9))) AS job_rev,
  MIN(o_orderdate) AS start_time, MAX(o_orderdate) AS finish_time, concat('TESTER', CAST(o_orderkey % 10 % 2 AS VARCHAR(9))) AS tester_type, concat('OP', CAST(o_orderkey % 10 % 3 AS VARCHAR(9))) AS operator
FROM orders GROUP BY o_orderkey % 10"""

WAFERS_SQL = """
SELECT wafer_id, lot_id, CAST(1 AS BIGINT) AS head_num, CAST(COUNT(*) AS BIGINT) AS part_count, CAST(SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS good_count, retest_num
FROM m_parts WHERE wafer_id <> '' GROUP BY wafer_id, lot_id, retest_num"""

CHIPS_SQL = f"""
SELECT {C('p.lot_id p.part_id p.part_txt c.i')} AS chip_occurrence_index, concat(CAST(p.record_no * 2 + c.i AS VARCHAR(19)), '') AS efuse_raw, p.record_no % 17 <> 0 AS valid,
  CASE WHEN (p.record_no + c.i) % 3 = 0 THEN 6 WHEN (p.record_no + c.i) % 7 = 0 THEN 5 ELSE 1 END AS origin_fab_code,
  CASE WHEN (p.record_no + c.i) % 3 = 0 THEN 'TSMC2' WHEN (p.record_no + c.i) % 7 = 0 THEN 'UNSUPPORTED' ELSE 'TSMC1' END AS origin_fab,
  concat('L', CAST((p.record_no + c.i) % 7 AS VARCHAR(9))) AS origin_lot, (p.record_no + c.i) % 5 AS origin_wafer,
  CAST(floor(p.record_no / 50) AS BIGINT) % 20 - 10 AS origin_x, CAST(floor(p.record_no / 1000) AS BIGINT) - 10 AS origin_y, p.retest_num, p.product
FROM m_parts p CROSS JOIN (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT CAST(1 AS BIGINT)) c
WHERE p.test_category = 'FT'"""

#: A total order of measurements within a run.
ORDER = ("record_no", "test_num", "k1", "k2", "result", "passed")

_KEY = "product, test_category, sub_process, lot_id, wafer_id, x_coord, y_coord, if((x_coord, y_coord) = (-32768, -32768), part_txt, ''), test_num, pin_num"

#: CTEs for DuckDB, ending in the views' names.
CTES = f"""m_parts AS ({PARTS_SQL}), m_rows AS ({ROWS_SQL}), lots AS ({LOTS_SQL}), wafers AS ({WAFERS_SQL}), chipid AS ({CHIPS_SQL}), parts AS (SELECT * FROM m_parts),
test_data AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, retest_num ORDER BY {", ".join(ORDER)}) - 1 AS exec_seq, dense_rank() OVER (PARTITION BY {_KEY} ORDER BY retest_num DESC) - 1 AS retest_flag FROM m_rows),
parts_final AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY {C('lot_id wafer_id x_coord y_coord')}, if((x_coord, y_coord) = (-32768, -32768), part_txt, '') ORDER BY retest_num DESC, part_id DESC) = 1),
test_data_final AS (SELECT * FROM test_data WHERE retest_flag = 0),
chipid_final AS (SELECT * FROM chipid QUALIFY row_number() OVER (PARTITION BY lot_id, efuse_raw ORDER BY retest_num DESC, part_id DESC, chip_occurrence_index DESC) = 1),
gross_die(product, gross_die, gd_fail_bin) AS (VALUES {", ".join(f"('{p}', {g}, {b})" for p, (g, b) in GROSS.items())}),
wafer_yield_final AS (SELECT y.*, total - probed AS unprobed, round(good * 100.0 / nullif(total, 0), 2) AS yield_pct FROM (
  SELECT {C('w.lot_id w.wafer_id w.probed w.good')}, CASE WHEN w.wafer_id <> '' AND g.gross_die IS NOT NULL THEN greatest(w.probed, g.gross_die) ELSE w.probed END AS total, g.gd_fail_bin
  FROM (SELECT lot_id, wafer_id, count(*) AS probed, count(*) FILTER (WHERE passed) AS good FROM parts_final GROUP BY ALL) w
  LEFT JOIN (SELECT lot_id, max(product) AS product FROM lots GROUP BY lot_id) l USING (lot_id) LEFT JOIN gross_die g USING (product)) y)"""


def load(spark: SparkSession, sf_dir: str) -> Model:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.sql(PARTS_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
    rows = spark.sql(ROWS_SQL.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN m_parts", "JOIN {parts}"), lineitem=lineitem, parts=parts)
    test_data = with_retest_flag(with_exec_seq(rows, *ORDER))
    lots = spark.sql(LOTS_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
    wafers = spark.sql(WAFERS_SQL.replace("FROM m_parts", "FROM {parts}"), parts=parts)
    chipid = spark.sql(CHIPS_SQL.replace("FROM m_parts", "FROM {parts}"), parts=parts)
    return Model(lots=lots, wafers=wafers, parts=parts, test_data=test_data, chipid=chipid, gross_die=gross_die_table(spark, GROSS))
