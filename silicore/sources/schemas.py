"""Schemas of the stored tables. Every logical column lies in the files; the partition
columns of the store are separate (see ``store``)."""

from __future__ import annotations

from pyspark.sql.types import StructType

_RUN = "product string, test_category string, sub_process string"

LOTS = "lot_id string, product string, test_category string, sub_process string, part_type string, job_name string, job_rev string, start_time timestamp, finish_time timestamp, tester_type string, operator string"
WAFERS = "wafer_id string, lot_id string, head_num bigint, start_time timestamp, finish_time timestamp, part_count bigint, good_count bigint, rtst_count bigint, abrt_count bigint, test_rev string, retest_num bigint, source_file string"
PARTS = "part_id string, part_txt string, lot_id string, wafer_id string, head_num bigint, site_num bigint, x_coord bigint, y_coord bigint, hard_bin bigint, soft_bin bigint, passed boolean, test_count bigint, test_time bigint, retest_num bigint"
TEST_DATA = "lot_id string, wafer_id string, part_id string, part_txt string, x_coord bigint, y_coord bigint, test_num bigint, test_name string, rec_type string, lo_limit double, hi_limit double, units string, result double, passed string, retest_num bigint, pin_num bigint, pin_name string, exec_seq bigint, retest_flag bigint"
CHIPID = "lot_id string, part_id string, part_txt string, chip_occurrence_index bigint, efuse_raw string, valid boolean, origin_fab_code bigint, origin_fab string, origin_lot string, origin_wafer bigint, origin_x bigint, origin_y bigint, reserved_bits string, retest_num bigint"
GROSS_DIE = "product string, gross_die bigint, gd_fail_bin bigint"

TABLES = {"lots": LOTS, "wafers": WAFERS, "parts": PARTS, "test_data": TEST_DATA, "chipid": CHIPID}


def stored(table: str) -> StructType:
    """The schema of a table's files: its columns, and the run's keys where it lacks them."""
    base = StructType.fromDDL(TABLES[table])
    for f in StructType.fromDDL(_RUN).fields:
        if f.name not in base.fieldNames():
            base = base.add(f)
    return base
