"""Named queries over the driver's tables, and each one's DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silicore.functions.expr import cols, decode_efuse, finite, rounded
from silicore.operators import analysis as A
from silicore.operators import recipes as R
from silicore.operators.retest import verify_flags
from silicore.plans import ingest_queries
from silicore.plans.driver_model import CTES, load
from silicore.plans.views import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(ingest_queries.QUERIES)
ORACLES: dict[str, str] = dict(ingest_queries.ORACLES)

LOTS3 = ["L0", "L1", "L8"]
CP = ("P0", "CP", "CP1")


def add(name: str, build: Callable[[Model], DataFrame], sql: str | None, more: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: build(load(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"WITH {CTES}{', ' + more if more else ''} {sql}"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(100.0 * ({part}) / nullif({whole}, 0), {digits})"


def C(names: str) -> str:  # noqa: N802
    return ", ".join(names.split())


def r(expr: str, digits: int) -> str:
    return f"round({expr}, {digits})"


def cpk(mean: str, sd: str, lo: str, hi: str) -> str:
    return f"least(({hi} - {mean}) / nullif(3 * {sd}, 0), ({mean} - {lo}) / nullif(3 * {sd}, 0))"


GOOD = "count(*) FILTER (WHERE passed)"
FAIL = "count(*) FILTER (WHERE passed = 'F')"
YIELD = f"count(*) AS dies, {GOOD} AS good, {pct(GOOD, 'count(*)')} AS yield_pct"
NUMERIC = "rec_type <> 'FTR' AND result IS NOT NULL"
LIMITED = "rec_type <> 'FTR' AND hi_limit IS NOT NULL AND lo_limit IS NOT NULL"
TEST = "test_num, test_name, units, lo_limit, hi_limit"
SPREAD = "stddev_samp(result)"
TEXT = "if((x_coord, y_coord) = (-32768, -32768), part_txt, '') AS txt"

# -- views

PART_COLS = [*cols("part_id part_txt lot_id wafer_id x_coord y_coord hard_bin soft_bin passed retest_num")]
ROW_COLS = [*cols("lot_id wafer_id part_id test_num pin_num result passed retest_num exec_seq retest_flag")]
add("parts_final", lambda m: m.parts_final.select(*PART_COLS), f"SELECT {', '.join(PART_COLS)} FROM parts_final")
add("test_data_final", lambda m: m.test_data_final.select(*ROW_COLS), f"SELECT {', '.join(ROW_COLS)} FROM test_data_final")
add("chipid_final", lambda m: m.chipid_final, "SELECT * FROM chipid_final")
add("wafer_yield_final", lambda m: m.wafer_yield_final, "SELECT * FROM wafer_yield_final")
add("retest_flag_dense_rank", lambda m: m.test_data.groupBy("lot_id", "retest_num", "retest_flag").agg(F.count(F.lit(1)).alias("n")), "SELECT lot_id, retest_num, retest_flag, count(*) AS n FROM test_data GROUP BY ALL")
add("exec_seq", lambda m: m.test_data.groupBy("rec_type", "exec_seq").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("result"), 2).alias("total")), "SELECT rec_type, exec_seq, count(*) AS n, round(sum(result), 2) AS total FROM test_data GROUP BY ALL")
_FLAG_KEY = f"SELECT {C('lot_id wafer_id x_coord y_coord')}, {TEXT}, {C('test_num pin_num retest_num retest_flag')} FROM test_data"
add("verify_flags", lambda m: verify_flags(m.test_data), f"""SELECT lot_id, CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(nulls) AS BIGINT) AS null_flags, count(*) FILTER (WHERE lo <> 0) AS orphaned_keys, CAST(sum(mixed) AS BIGINT) AS inconsistent_runs, count(*) FILTER (WHERE cur > 1) AS dup_current
FROM (SELECT lot_id, sum(n) AS n, sum(nulls) AS nulls, min(lo) AS lo, count(*) FILTER (WHERE lo <> hi) AS mixed, count(*) FILTER (WHERE cur) AS cur FROM (
SELECT {C('lot_id wafer_id x_coord y_coord txt test_num pin_num retest_num')}, count(*) AS n, count(*) FILTER (WHERE retest_flag IS NULL) AS nulls, min(retest_flag) AS lo, max(retest_flag) AS hi, bool_or(retest_flag = 0) AS cur FROM ({_FLAG_KEY}) GROUP BY ALL)
GROUP BY {C('lot_id wafer_id x_coord y_coord txt test_num pin_num')}) GROUP BY lot_id""")

# -- analysis

_HEAD = "lot_id, product, test_category, sub_process, part_type, job_name, job_rev"
add("lot_summary", A.lot_summary, f"""SELECT {_HEAD}, wafer_count, CAST(total_parts AS BIGINT) AS total_parts, CAST(good_parts AS BIGINT) AS good_parts, {pct('good_parts', 'total_parts')} AS yield_pct
FROM lots LEFT JOIN (SELECT lot_id, sum(good) AS good_parts, sum(total) AS total_parts, count(nullif(wafer_id, '')) AS wafer_count FROM wafer_yield_final GROUP BY lot_id) USING (lot_id)""")
add("wafer_yield", lambda m: A.wafer_yield(m, "L0"), f"SELECT {C('wafer_id total good yield_pct')} FROM wafer_yield_final WHERE lot_id = 'L0'")
add("test_fail_rate", lambda m: A.test_fail_rate(m, "L0", 3), f"SELECT test_num, test_name, count(*) AS total, {FAIL} AS fails, {pct(FAIL, 'count(*)')} AS fail_rate FROM test_data_final WHERE lot_id = 'L0' GROUP BY ALL HAVING fails > 0 ORDER BY fail_rate DESC, test_num LIMIT 3")
_BINNED = """binned AS (SELECT lot_id, soft_bin, count(*) AS c FROM parts_final GROUP BY ALL
UNION ALL SELECT lot_id, gd_fail_bin, sum(unprobed) FROM wafer_yield_final WHERE gd_fail_bin IS NOT NULL AND unprobed > 0 GROUP BY ALL)"""
add("bin_summary", lambda m: A.bin_summary(m, "L0"), f"SELECT soft_bin, CAST(sum(c) AS BIGINT) AS \"count\", {pct('sum(c)', 'sum(sum(c)) OVER ()')} AS pct FROM binned WHERE lot_id = 'L0' GROUP BY soft_bin", _BINNED)
_IN3 = "('L0', 'L1', 'L8')"
add("yield_by_lot", lambda m: A.yield_by_lot(m, LOTS3), f"SELECT {C('lot_id wafer_id total good yield_pct')} FROM wafer_yield_final WHERE lot_id IN {_IN3}")
add("bin_pareto_by_lot", lambda m: A.bin_pareto_by_lot(m, LOTS3), f"SELECT lot_id, soft_bin, CAST(sum(c) AS BIGINT) AS \"count\", {pct('sum(c)', 'sum(sum(c)) OVER (PARTITION BY lot_id)')} AS pct FROM binned WHERE lot_id IN {_IN3} GROUP BY lot_id, soft_bin", _BINNED)
_STATS = f"count(*) AS n, {r('avg(result)', 6)} AS mean, {r('stddev_pop(result)', 6)} AS std, {r(cpk('avg(result)', 'stddev_pop(result)', 'min(lo_limit)', 'max(hi_limit)'), 3)} AS cpk"
add("test_stats_by_lot", lambda m: A.test_stats_by_lot(m, LOTS3), f"""SELECT lot_id, test_num, {_STATS}, min(lo_limit) AS lo_limit, max(hi_limit) AS hi_limit FROM test_data_final
WHERE lot_id IN {_IN3} AND {LIMITED} AND result IS NOT NULL AND test_num IN (SELECT DISTINCT test_num FROM test_data_final WHERE lot_id IN {_IN3} AND passed = 'F') GROUP BY lot_id, test_num""")
_START = "(SELECT lot_id, max(start_time) AS start_t FROM lots WHERE product = '{}' AND test_category = 'CP' GROUP BY lot_id)"
_LAST = "ORDER BY start_t DESC, lot_id DESC LIMIT {}"
add("lot_trend", lambda m: A.lot_trend(m, "P0", "CP", 2), f"SELECT lot_id, start_t, count(*) AS total, {GOOD} AS good, {pct(GOOD, 'count(*)')} AS yield_pct FROM parts_final JOIN {_START.format('P0')} USING (lot_id) GROUP BY ALL {_LAST.format(2)}")
add("test_trend", lambda m: A.test_trend(m, "P1", "CP", 2, 1), f"SELECT lot_id, start_t, {_STATS} FROM test_data_final JOIN {_START.format('P1')} USING (lot_id) WHERE test_num = 2 AND {NUMERIC} GROUP BY lot_id, start_t {_LAST.format(1)}")
add("control_limits", lambda m: A.control_limits(A.lot_trend(m, "P0", "CP"), "yield_pct"), f"""SELECT {r('avg(y)', 6)} AS mean, {r('avg(y) + 3 * stddev_pop(y)', 6)} AS upper, {r('avg(y) - 3 * stddev_pop(y)', 6)} AS lower
FROM (SELECT {pct(GOOD, 'count(*)')} AS y FROM parts_final JOIN {_START.format('P0')} USING (lot_id) GROUP BY lot_id)""")
_SIDE = f"(SELECT lot_id, count(*) AS {{0}}_total, {pct(GOOD, 'count(*)')} AS {{0}}_yield_pct FROM parts_final WHERE product = 'P1' AND test_category = upper('{{0}}') GROUP BY lot_id)"
add("cp_ft_yield", lambda m: A.cp_ft_yield(m, "P1"), f"SELECT {C('lot_id cp_total cp_yield_pct ft_total ft_yield_pct')} FROM {_SIDE.format('cp')} FULL JOIN {_SIDE.format('ft')} USING (lot_id)")
add("die_cp_ft_join", lambda m: A.die_cp_ft_join(m, "P0", "L8"), """SELECT origin_fab, p.passed AS cp_passed, p.hard_bin AS cp_hard_bin, p.soft_bin AS cp_soft_bin, p.wafer_id AS cp_wafer_id_str, c.origin_y AS cp_y, c.origin_x AS cp_x, c.origin_wafer AS cp_wafer, c.origin_lot AS cp_lot_id, c.part_txt AS ft_part_txt, c.part_id AS ft_part_id
FROM (SELECT * FROM chipid_final WHERE valid AND lot_id = 'L8') c JOIN (SELECT *, TRY_CAST(wafer_id AS BIGINT) AS wn FROM parts_final WHERE test_category = 'CP' AND product = 'P0') p
ON c.origin_lot = p.lot_id AND c.origin_y = p.y_coord AND c.origin_x = p.x_coord AND coalesce(p.wn, c.origin_wafer) = c.origin_wafer""")
_V = "v AS (SELECT part_id, test_num, avg(result) AS v FROM test_data_final WHERE lot_id = 'L0' AND test_num IN (1, 2, 3) AND " + NUMERIC + " GROUP BY ALL)"
add("test_correlation_long", lambda m: A.test_correlation(m, "L0", [1, 2, 3]), "SELECT a.test_num AS test_a, b.test_num AS test_b, count(*) AS n, round(CASE WHEN stddev_pop(a.v) * stddev_pop(b.v) = 0 THEN NULL ELSE covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END, 6) AS r FROM v a JOIN v b USING (part_id) GROUP BY ALL", _V)
_RAD = """ext AS (SELECT (max(y_coord) + min(y_coord)) / 2.0 AS cy, (max(x_coord) + min(x_coord)) / 2.0 AS cx FROM parts_final WHERE lot_id = 'L0'),
rad AS (SELECT p.*, sqrt((x_coord - cx) * (x_coord - cx) + (y_coord - cy) * (y_coord - cy)) AS rad FROM parts_final p CROSS JOIN ext WHERE lot_id = 'L0'),
rn AS (SELECT *, CASE WHEN (SELECT max(rad) FROM rad) = 0 THEN 0 ELSE rad / (SELECT max(rad) FROM rad) END AS rnorm FROM rad)"""
add("zone_yield", lambda m: A.zone_yield(m, "L0"), f"SELECT (['center', 'mid', 'edge'])[zone_idx + 1] AS zone, zone_idx, count(*) AS total, {GOOD} AS good, {pct(GOOD, 'count(*)')} AS yield_pct FROM (SELECT passed, CAST(least(2, floor(rnorm * 3)) AS INT) AS zone_idx FROM rn) GROUP BY zone_idx", _RAD)
add("zone_yield_5", lambda m: A.zone_yield(m, "L0", 5), f"SELECT 'zone_' || zone_idx AS zone, zone_idx, count(*) AS total, {GOOD} AS good, {pct(GOOD, 'count(*)')} AS yield_pct FROM (SELECT passed, CAST(least(4, floor(rnorm * 5)) AS INT) AS zone_idx FROM rn) GROUP BY zone_idx", _RAD)
add("radial_profile", lambda m: A.radial_profile(m, "L0", 1), f"SELECT CAST(least(9, floor(rnorm * 10)) AS INT) AS radius_bin, count(*) AS n, {r('avg(result)', 6)} AS mean, {r('stddev_pop(result)', 6)} AS std FROM (SELECT part_id, result FROM test_data_final WHERE lot_id = 'L0' AND test_num = 1 AND {NUMERIC}) JOIN rn USING (part_id) GROUP BY 1", _RAD)
add("radial_profile_by_die", lambda m: A.radial_profile(m, "L0", 1, by="die"), f"SELECT CAST(least(9, floor(rnorm * 10)) AS INT) AS radius_bin, count(*) AS n, {r('avg(t.result)', 6)} AS mean, {r('stddev_pop(t.result)', 6)} AS std FROM (SELECT {C('wafer_id x_coord y_coord result')} FROM test_data_final WHERE lot_id = 'L0' AND test_num = 1 AND {NUMERIC}) t JOIN rn USING (wafer_id, x_coord, y_coord) GROUP BY 1", _RAD)
add("wafermap_avg", lambda m: A.wafermap(m, "L0", "W01", 1), f"SELECT x_coord, y_coord, {r('avg(result)', 6)} AS result FROM test_data_final WHERE lot_id = 'L0' AND wafer_id = 'W01' AND test_num = 1 AND result IS NOT NULL GROUP BY ALL")
_HIST = "h AS (SELECT lot_id, result, min(result) OVER () AS lo, max(result) OVER () AS hi FROM test_data_final WHERE lot_id IN " + _IN3 + " AND test_num = 1 AND result IS NOT NULL)"
add("histogram_bins", lambda m: A.histogram(m, LOTS3, 1), f"SELECT lot_id, b AS bin, {r('lo + (hi - lo) / 40 * b', 6)} AS bin_lo, {r('lo + (hi - lo) / 40 * (b + 1)', 6)} AS bin_hi, count(*) AS n FROM (SELECT *, CAST(least(39, floor(coalesce((result - lo) / nullif(hi - lo, 0), 0) * 40)) AS INT) AS b FROM h) GROUP BY {C('lot_id b lo hi')}", _HIST)
add("session_lots", lambda m: A.session_lots(m, "P0"), "SELECT * FROM lots WHERE product = 'P0'")
_ON = "lot_id, wafer_id, part_id"
_EXPORT = f"SELECT {C('lot_id wafer_id part_id p.x_coord p.y_coord hard_bin soft_bin p.passed')} AS {C('die_passed test_num test_name result lo_limit hi_limit units t.passed')} AS test_passed FROM parts_final p JOIN test_data_final t USING (lot_id, wafer_id, part_id) WHERE lot_id IN ('L0', 'L8')"
add("export_lot_long", lambda m: R.q_csv(m, ["L0", "L8"]), _EXPORT)
_PIV = ", ".join(f"arg_min(result, (test_num, exec_seq, result)) FILTER (WHERE test_name = 'T{i}' AND result IS NOT NULL) AS T{i}" for i in range(1, 7))
add("export_lot_pivot", lambda m: R.lot_pivot(m, ["L0", "L8"], [f"T{i}" for i in range(1, 7)]), f"SELECT {C('lot_id wafer_id part_id x.x_coord x.y_coord hard_bin soft_bin x.passed')} AS die_passed, {_PIV} FROM parts_final x JOIN test_data_final t USING ({_ON}) WHERE lot_id IN ('L0', 'L8') AND result IS NOT NULL GROUP BY {_ON}, {C('x.x_coord x.y_coord hard_bin soft_bin x.passed')}")

# -- reports

_JOB = "product, sub_process, job_name, job_rev"
_L0, _W1 = "lot_id = 'L0'", "lot_id = 'L0' AND wafer_id = 'W01'"
add("r1_1", R.r1_1, f"SELECT DISTINCT {_JOB} FROM lots")
add("r1_2", R.r1_2, f"SELECT {_JOB}, max(start_time) AS last_used FROM lots GROUP BY ALL")
add("r1_3", lambda m: R.r1_3(m, "L3"), "SELECT * EXCLUDE (test_category, part_type) FROM lots WHERE lot_id = 'L3'")
add("r1_4", lambda m: R.r1_4(m, "L3"), f"""SELECT lot_id, {_JOB.replace('product', 'l.product').replace('sub_process', 'l.sub_process')}, {C('tester_type operator part_id p.wafer_id p.part_txt p.x_coord p.y_coord hard_bin soft_bin p.passed')} AS {C('die_passed p.retest_num test_num test_name rec_type result lo_limit hi_limit units t.passed')} AS test_passed
FROM lots l JOIN parts_final p USING (lot_id) JOIN test_data_final t USING (lot_id, part_id) WHERE lot_id = 'L3'""")
_LC = "lot_id, product, sub_process, start_time, finish_time, job_name, job_rev"
add("r2_1", lambda m: R.r2_1(m, "P0", "CP1"), f"SELECT {_LC} FROM lots WHERE sub_process = 'CP1' AND product = 'P0'")
add("r2_2", lambda m: R.r2_2(m, "1995-01-02", "1995-01-04"), "SELECT * FROM lots WHERE start_time < TIMESTAMP '1995-01-04' AND start_time >= TIMESTAMP '1995-01-02'")
add("r2_3", R.r2_3, f"SELECT {C('lot_id l.product l.test_category l.sub_process job_name')}, {YIELD} FROM lots l JOIN parts_final USING (lot_id) GROUP BY ALL")
add("r3_1", lambda m: R.r3_1(m, "L0"), f"SELECT wafer_id, {YIELD} FROM parts_final WHERE {_L0} GROUP BY wafer_id")
add("r3_2", lambda m: R.r3_2(m, "L0"), f"SELECT * FROM (SELECT wafer_id, {YIELD} FROM parts_final WHERE {_L0} GROUP BY wafer_id) WHERE yield_pct < 90")
add("r3_3", lambda m: R.r3_3(m, "L0"), f"""SELECT {C('wafer_id wrr_good wrr_total parts_good parts_total')}, {pct('wrr_good', 'wrr_total')} AS wrr_yield, {pct('parts_good', 'parts_total')} AS parts_yield
FROM (SELECT wafer_id, arg_max(good_count, retest_num) AS wrr_good, arg_max(part_count, retest_num) AS wrr_total FROM wafers WHERE {_L0} GROUP BY wafer_id) JOIN (SELECT wafer_id, {GOOD} AS parts_good, count(*) AS parts_total FROM parts_final WHERE {_L0} GROUP BY wafer_id) USING (wafer_id)""")
add("r3_4", lambda m: R.r3_4(m, "L0", "W01"), f"SELECT {C('x_coord y_coord hard_bin soft_bin passed')} FROM parts_final WHERE {_W1}")
add("r3_5", lambda m: R.r3_5(m, "L0", "W01", 6, 10), f"SELECT zone, {YIELD} FROM (SELECT passed, CASE WHEN d <= 6 THEN '1_center' WHEN d <= 10 THEN '2_middle' ELSE '3_edge' END AS zone FROM (SELECT passed, sqrt(x_coord ** 2 + y_coord ** 2) AS d FROM parts_final WHERE {_W1})) GROUP BY zone")
add("r4_1", lambda m: R.r4_1(m, "L0", "W01"), f"SELECT {C('part_id x_coord y_coord hard_bin soft_bin test_count test_time')} FROM parts_final WHERE {_W1} AND NOT passed")
_BIN = "SELECT *, round(100.0 * die_count / sum(die_count) OVER (), 2) AS pct FROM (SELECT soft_bin, hard_bin, count(*) AS die_count FROM parts_final WHERE {} GROUP BY 1, 2)"
add("r4_2", lambda m: R.r4_2(m, "L0", "W01"), _BIN.format(_W1))
add("r4_3", lambda m: R.r4_3(m, "L0"), f"""SELECT soft_bin, n AS die_count, {pct('n', 'sum(n) OVER ()')} AS pct, {pct('sum(n) OVER (ORDER BY n DESC)', 'sum(n) OVER ()')} AS cumulative_pct
FROM (SELECT soft_bin, count(*) AS n FROM parts_final WHERE {_L0} AND NOT passed GROUP BY soft_bin)""")
add("r4_4", lambda m: R.r4_4(m, "L0", "W01"), "SELECT p.x_coord, p.y_coord, count(*) AS fail_neighbors FROM bad p, bad q WHERE abs(q.x_coord - p.x_coord) + abs(q.y_coord - p.y_coord) = 1 GROUP BY ALL", f"bad AS (SELECT x_coord, y_coord FROM parts_final WHERE {_W1} AND NOT passed)")
_Q5 = ", ".join(f"{r(e, 4)} AS {n}" for n, e in (("avg_val", "avg(result)"), ("stddev_val", SPREAD), ("min_val", "min(result)"), ("max_val", "max(result)"), ("median_val", "median(result)"), ("q1", "quantile_cont(result, 0.25)"), ("q3", "quantile_cont(result, 0.75)")))
_T1 = "lot_id = 'L0' AND test_name = 'T1'"
add("r5_1", lambda m: R.r5_1(m, "L0", "T1"), f"SELECT {TEST}, count(*) AS cnt, {_Q5} FROM test_data_final WHERE {_T1} GROUP BY ALL")
add("r5_2", lambda m: R.r5_2(m, "L0", "W01"), f"SELECT {C('part_id x_coord y_coord test_num test_name result lo_limit hi_limit units')} FROM test_data_final WHERE {_W1} AND passed = 'F'")
_RANK = f"SELECT test_num, test_name, count(*) AS total, {FAIL} AS fail_cnt, {pct(FAIL, 'count(*)')} AS fail_pct FROM test_data_final WHERE lot_id = 'L1' GROUP BY ALL HAVING fail_cnt > 0"
add("r5_3", lambda m: R.r5_3(m, "L1"), _RANK)
add("r5_4", lambda m: R.r5_4(m, "L0", m.test_data_final.where("lot_id = 'L0'").agg(F.min("part_id")).first()[0]), f"SELECT {C('test_num test_name rec_type result lo_limit hi_limit units passed')} FROM test_data_final WHERE lot_id = 'L0' AND part_id = (SELECT min(part_id) FROM test_data_final WHERE lot_id = 'L0')")
add("r5_5", lambda m: R.r5_5(m, "L0"), f"SELECT {TEST}, {r('mu', 4)} AS mean, {r('100.0 * least(mu - lo_limit, hi_limit - mu) / nullif(hi_limit - lo_limit, 0)', 2)} AS margin_pct FROM (SELECT {TEST}, avg(result) AS mu, count(*) AS n FROM test_data_final WHERE {_L0} AND {LIMITED} GROUP BY ALL) WHERE n > 1")
add("r5_6", lambda m: R.r5_6(m, "L0", "T1", 1.5), f"SELECT {C('part_id x_coord y_coord result')}, {r('(result - mu) / nullif(sd, 0)', 2)} AS z_score FROM (SELECT *, avg(result) OVER (PARTITION BY test_num) AS mu, stddev_samp(result) OVER (PARTITION BY test_num) AS sd FROM test_data_final WHERE {_T1}) WHERE abs(result - mu) > 1.5 * sd")
_MS = f"count(*) AS n, {r('avg(result)', 4)} AS mean, {r(SPREAD, 4)} AS sigma"
add("r5_7", lambda m: R.r5_7(m, "L0", "T1"), f"SELECT site_num, test_name, {_MS} FROM (SELECT part_id, test_name, result FROM test_data_final WHERE {_T1}) JOIN parts_final USING (part_id) GROUP BY ALL")
add("r5_8", lambda m: R.r5_8(m, "L0", "T1", "T2"), f"SELECT count(*) AS n, {r('corr(a, b)', 4)} AS pearson_r, {r('regr_slope(b, a)', 6)} AS slope, {r('regr_intercept(b, a)', 6)} AS intercept FROM (SELECT part_id, max(result) FILTER (WHERE test_name = 'T1') AS a, max(result) FILTER (WHERE test_name = 'T2') AS b FROM test_data_final WHERE {_L0} GROUP BY part_id) WHERE a IS NOT NULL AND b IS NOT NULL")
add("r5_9", lambda m: R.r5_9(m, "L0", "T5"), f"SELECT pin_num, pin_name, units, {_MS} FROM test_data_final WHERE {_L0} AND rec_type = 'MPR' AND test_name = 'T5' GROUP BY ALL")
add("r6_1", lambda m: R.r6_1(m, "L0"), f"SELECT retest_num, count(*) AS dies FROM parts_final WHERE {_L0} GROUP BY ALL")
_UNIT = "lot_id, wafer_id, x_coord, y_coord, part_txt"
add("r6_2", lambda m: R.r6_2(m, "L0"), f"SELECT count(*) AS dies, count(*) FILTER (WHERE a) AS good_run0, count(*) FILTER (WHERE b) AS good_final, count(*) FILTER (WHERE b AND NOT a) AS recovered_by_retest FROM (SELECT {_UNIT}, passed AS a FROM parts WHERE {_L0} AND retest_num = 0) JOIN (SELECT {_UNIT}, passed AS b FROM parts_final) USING ({_UNIT})")
add("r6_3", lambda m: R.r6_3(m, "L8"), f"SELECT {C('wafer_id part_txt x_coord y_coord hard_bin soft_bin retest_num')} FROM parts_final WHERE retest_num > 0 AND NOT passed AND lot_id = 'L8'")
add("r7_1", lambda m: R.r7_1(m, "P0"), f"SELECT count(DISTINCT lot_id) AS lot_count, l.sub_process, l.product, date_trunc('day', start_time) AS test_date, {YIELD} FROM lots l JOIN parts_final USING (lot_id) WHERE l.product = 'P0' GROUP BY ALL")
add("r7_2", R.r7_2, f"SELECT tester_type, operator, count(DISTINCT lot_id) AS lot_count, {YIELD} FROM lots JOIN parts_final USING (lot_id) GROUP BY ALL")
_PK = "lot_id, wafer_id, x_coord, y_coord, txt"
_FAILS = f"""bad_die AS (SELECT *, {TEXT} FROM parts_final), bad_row AS (SELECT *, {TEXT} FROM test_data_final WHERE passed = 'F'),
f3 AS (SELECT DISTINCT {_PK}, {C('hard_bin soft_bin test_num test_name')} FROM (SELECT * FROM bad_die WHERE NOT passed) JOIN bad_row USING ({_PK})),
g3 AS (SELECT *, (SELECT count(DISTINCT test_num) FROM f3 z WHERE (z.lot_id, {C('z.wafer_id z.x_coord z.y_coord z.txt')}) = (f3.lot_id, f3.wafer_id, f3.x_coord, f3.y_coord, f3.txt)) AS nt FROM f3 WHERE lot_id = 'L1')"""
add("r7_3", lambda m: R.r7_3(m, "L1"), f"SELECT {C('wafer_id hard_bin soft_bin test_num test_name')}, count(*) AS fail_dies, count(*) FILTER (WHERE nt = 1) AS sole_fail_dies, {pct('count(*)', 'min(bd)', 1)} AS pct_of_bin FROM g3 JOIN (SELECT wafer_id, soft_bin, count(DISTINCT (x_coord, y_coord, txt)) AS bd FROM g3 GROUP BY ALL) USING (wafer_id, soft_bin) GROUP BY ALL", _FAILS)
add("r7_4", lambda m: R.r7_4(m, "L1"), f"SELECT {C('lot_id wafer_id x_coord y_coord t.part_txt hard_bin soft_bin d.passed')} AS {C('die_passed test_num test_name rec_type exec_seq result lo_limit hi_limit units')} FROM bad_row t LEFT JOIN bad_die d USING ({_PK}) WHERE lot_id = 'L1'", _FAILS)
add("r7_5", lambda m: R.r7_5(m, LOTS3), f"SELECT lot_id, job_rev, {YIELD} FROM lots JOIN parts_final USING (lot_id) WHERE lot_id IN {_IN3} GROUP BY ALL")
_CP = "round((hi_limit - lo_limit) / nullif(6 * {0}, 0), 3) AS cp, round(" + cpk("{1}", "{0}", "lo_limit", "hi_limit") + ", 3) AS cpk"
add("r8_1", lambda m: R.r8_1(m, "L0"), f"SELECT {TEST}, n, {r('mu', 6)} AS mean, {r('sd', 6)} AS sigma, {_CP.format('sd', 'mu')} FROM (SELECT {TEST}, count(*) AS n, avg(result) AS mu, {SPREAD} AS sd FROM test_data_final WHERE {_L0} AND {LIMITED} GROUP BY ALL) WHERE n > 1 AND sd > 0")
_REAL = "rec_type IN ('PTR', 'MPR') AND isfinite(result) AND isfinite(lo_limit) AND isfinite(hi_limit) AND lo_limit < hi_limit"
_SCOPE = f"""tgt AS (SELECT {C('lot_id job_name job_rev start_time')} FROM lots WHERE product = 'P0' AND test_category = 'CP' AND sub_process = 'CP1'),
scoped AS (SELECT t.*, g.job_name, g.job_rev FROM test_data_final t JOIN tgt g USING (lot_id) WHERE t.product = 'P0' AND t.test_category = 'CP' AND t.sub_process = 'CP1'),
base AS (SELECT * FROM scoped WHERE {_REAL} AND regexp_matches(upper(trim(units)), '^.?[VA]$')),
ref AS (SELECT * FROM tgt ORDER BY start_time DESC, lot_id DESC LIMIT 1),
spec AS (SELECT test_num, min(lo_limit) AS lsl, min(hi_limit) AS usl FROM scoped WHERE {_REAL} AND lot_id = (SELECT lot_id FROM ref) GROUP BY test_num)"""
DIGITS = "CAST(greatest(6 - floor(log10({})), 6) AS INT)"
_SIG = "coalesce({1}({0} / 10 ** (floor(log10(abs(nullif({0}, 0)))) - 2)) * 10 ** (floor(log10(abs(nullif({0}, 0)))) - 2), 0 * {0})"
_REVIEW = f"""{_SCOPE},
st AS (SELECT test_num, min(test_name) AS test_name, min(units) AS units, count(*) AS n, {FAIL} AS fail_n, avg(result) AS mu, {SPREAD} AS sd, min(result) AS lo, max(result) AS hi, count(DISTINCT lo_limit) > 1 OR count(DISTINCT hi_limit) > 1 AS limits_changed FROM base GROUP BY test_num),
ln AS (SELECT st.*, lsl, usl, {DIGITS.format('least(nullif(abs(mu), 0), sd)')} AS d, {_SIG.format('(mu - 3.99 * sd)', 'floor')} AS wl, {_SIG.format('(mu - 9.0 * sd)', 'floor')} AS tl, {_SIG.format('(mu + 3.99 * sd)', 'ceil')} AS wu, {_SIG.format('(mu + 9.0 * sd)', 'ceil')} AS tu FROM st LEFT JOIN spec USING (test_num) WHERE n > 1 AND sd > 0),
nw AS (SELECT *, greatest(least(lsl, wl), tl) AS nl, least(greatest(usl, wu), tu) AS nu, lsl IS NULL OR usl IS NULL AS bare FROM ln)"""
_SHOW = ", ".join(f"round({e}, d) AS {n}" for n, e in (("mean", "mu"), ("sigma", "sd"), ("min_val", "lo"), ("max_val", "hi"), ("cur_lsl", "lsl"), ("cur_usl", "usl"), ("new_lsl", "nl"), ("new_usl", "nu"), ("lsl_change", "nl - lsl"), ("usl_change", "nu - usl")))
add("r8_2", lambda m: R.r8_2(m, *CP), f"""SELECT * FROM (SELECT {C('test_num test_name units n fail_n')}, {pct('fail_n', 'n', 3)} AS fail_pct, {_SHOW}, ref.lot_id AS ref_lot_id, ref.job_name AS latest_job_name, ref.job_rev AS latest_job_rev, limits_changed, round((usl - lsl) / (6 * sd), 3) AS cp_current,
CASE WHEN NOT bare THEN round(least((usl - mu) / (3 * sd), (mu - lsl) / (3 * sd)), 3) END AS cpk_current, CASE WHEN bare THEN 'NO_BASELINE' WHEN (nl, nu) = (lsl, usl) THEN 'NO_CHANGE' WHEN lsl < nl AND usl > nu THEN 'TIGHTEN' WHEN lsl > nl AND usl < nu THEN 'LOOSEN' ELSE 'MIXED' END AS direction,
concat_ws(',', CASE WHEN n < 30 THEN 'LOW_SAMPLE' END, CASE WHEN bare THEN 'NOT_IN_LATEST_LOT' END, CASE WHEN limits_changed THEN 'LIMIT_CHANGED' END) AS flags FROM nw CROSS JOIN ref) WHERE cpk_current IS NULL OR cpk_current < 1.33""", _REVIEW)
add("r8_2b", R.r8_2b, "SELECT test_num, count(DISTINCT test_name) AS name_variants, string_agg(DISTINCT test_name, ', ' ORDER BY test_name) AS names FROM test_data_final GROUP BY test_num HAVING name_variants > 1")
_DUMP = ", ".join(R.DUMP[:-1]) + ", passed AS test_passed"
add("r8_3", lambda m: R.r8_3(m, *CP), f"SELECT {_DUMP} FROM base", _SCOPE)
add("r8_3b", lambda m: R.r8_3b(R.r8_3(m, *CP)), f"SELECT test_num, n, f AS fail_n, round(sd, {DIGITS.format('nullif(sd, 0)')}) AS sigma, round(mu, {DIGITS.format('nullif(abs(mu), 0)')}) AS mean FROM (SELECT test_num, count(*) AS n, {FAIL} AS f, avg(result) AS mu, {SPREAD} AS sd FROM base GROUP BY test_num)", _SCOPE)
CSV = [("1", "5000", "70000"), ("2", "9000", "8000"), ("2", "9500", "8000"), ("3", "", "60000"), ("9", "1", "2")]
_CSV = "csv AS (SELECT test_num, min(l) AS rev_lsl, min(u) AS rev_usl, count(*) AS csv_rows FROM (VALUES " + ", ".join(f"({a}, {b or 'NULL'}::DOUBLE, {c or 'NULL'}::DOUBLE)" for a, b, c in CSV) + ") v(test_num, l, u) GROUP BY test_num)"


def _csv(m: Model) -> DataFrame:
    return m.parts.sparkSession.createDataFrame(CSV, "test_num string, rev_lsl string, rev_usl string")


_JUDGE = f"""{_SCOPE}, {_CSV},
jr AS (SELECT b.*, {C('rev_lsl rev_usl csv_rows lsl usl result')} < rev_lsl OR result > rev_usl AS out_rev, result >= lsl AND result <= usl AS was_in FROM base b LEFT JOIN csv USING (test_num) LEFT JOIN spec USING (test_num)),
ja AS (SELECT test_num, min(test_name) AS test_name, min(units) AS units, count(*) AS n, avg(result) AS mu, {SPREAD} AS sd, min(result) AS lo, max(result) AS hi, max(lsl) AS lsl, max(usl) AS usl, max(rev_lsl) AS rev_lsl, max(rev_usl) AS rev_usl, max(csv_rows) AS cr, {FAIL} AS fc, count(*) FILTER (WHERE out_rev) AS fr, count(*) FILTER (WHERE out_rev AND was_in) AS fn FROM jr GROUP BY test_num),
jb AS (SELECT *, least((rev_usl - mu) / nullif(3 * sd, 0), (mu - rev_lsl) / nullif(3 * sd, 0)) AS k, {DIGITS.format('least(nullif(abs(mu), 0), nullif(sd, 0))')} AS d, rev_lsl IS NULL OR rev_usl IS NULL AS nr, lsl IS NULL OR usl IS NULL AS nc FROM ja)"""
_JSHOW = ", ".join(f"round({e}, d) AS {n}" for n, e in (("mean", "mu"), ("sigma", "sd"), ("min_val", "lo"), ("max_val", "hi"), ("cur_lsl", "lsl"), ("cur_usl", "usl")))
add("r8_4", lambda m: R.r8_4(m, _csv(m), *CP), f"""SELECT {C('test_num test_name units n')}, {_JSHOW}, rev_lsl, rev_usl, round(k, 3) AS cpk_rev, fc AS fail_n_cur, CASE WHEN NOT nr THEN fr END AS fail_n_rev, CASE WHEN NOT nr AND NOT nc THEN fn END AS n_newly_fail, CASE WHEN NOT nr THEN round(1000000.0 * fr / nullif(n, 0), 1) END AS fail_ppm_rev,
concat_ws(',', CASE WHEN nr THEN 'MISSING_IN_CSV' END, CASE WHEN nc THEN 'NO_CURRENT_SPEC' END, if(cr > 1, 'DUP_IN_CSV', NULL), if(rev_usl <= rev_lsl, 'INVERTED', NULL), if(hi > rev_usl OR lo < rev_lsl, 'OUTSIDE_MEASURED', NULL), CASE WHEN k < 1.33 THEN 'CPK_SHORT' END) AS flags FROM jb""", _JUDGE)
add("r8_4b", lambda m: R.r8_4b(R.r8_3(m, *CP), _csv(m)), f"SELECT {C('lot_id wafer_id x_coord y_coord part_txt test_num test_name result lo_limit hi_limit rev_lsl rev_usl')} FROM jr WHERE out_rev AND result BETWEEN lo_limit AND hi_limit", _JUDGE)


def _names(m: Model) -> DataFrame:
    return m.parts.sparkSession.createDataFrame([("T1",), ("T4",), ("T4",), ("NONE",)], "test_name string")


add("r8_5", lambda m: R.r8_5(m, _names(m), *CP), f"SELECT {_DUMP} FROM base WHERE test_name IN ('T1', 'T4')", _SCOPE)
add("r8_5b", lambda m: R.r8_5b(R.r8_5(m, _names(m), *CP), _names(m)), "SELECT n AS test_name FROM (VALUES ('T1'), ('T4'), ('NONE')) v(n) WHERE n NOT IN (SELECT test_name FROM base)", _SCOPE)
_TXT = "coalesce(CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({0} AS VARCHAR) END, 'NULL')"
_VAR = f"{_SCOPE}, va AS (SELECT {C('test_num lot_id wafer_id retest_num job_name job_rev')}, min(test_name) AS test_name, min(units) AS units, {_TXT.format('min(lo_limit)')} || ' / ' || {_TXT.format('min(hi_limit)')} AS lp FROM scoped WHERE rec_type IN ('PTR', 'MPR') GROUP BY {C('test_num lot_id wafer_id retest_num job_name job_rev')})".replace("product = 'P0'", "product = 'P1'").replace("t.product = 'P0'", "t.product = 'P1'")
CP1 = ("P1", "CP", "CP1")
add("r8_6a", lambda m: R.r8_6a(R.limit_variants(m, *CP1)), "SELECT test_num, count(DISTINCT test_name) AS name_variants, count(DISTINCT lp) AS limit_variants, count(*) AS files, min(test_name) AS test_name, string_agg(DISTINCT lp, '  |  ' ORDER BY lp) AS variants, string_agg(DISTINCT job_name || '/' || job_rev, ', ' ORDER BY job_name || '/' || job_rev) AS jobs FROM va GROUP BY test_num HAVING limit_variants > 1 OR name_variants > 1", _VAR)
add("r8_6b", lambda m: R.r8_6b(R.limit_variants(m, *CP1), 2), f"SELECT lp AS {C('limit_pair job_name job_rev units')}, max(wafer_id) AS wafer_max, min(wafer_id) AS wafer_min, string_agg(DISTINCT lot_id, ', ' ORDER BY lot_id) AS lots, count(*) AS files FROM va WHERE test_num = 2 GROUP BY ALL", _VAR)
_OR = "origin_lot, origin_wafer, origin_x, origin_y"
_PKG = "pk AS (SELECT c.*, p.passed FROM chipid_final c JOIN parts_final p USING (lot_id, part_txt) WHERE c.valid AND lot_id = 'L8')"
_BAD = "count(*) FILTER (WHERE NOT passed)"
add("r9_1", lambda m: R.r9_1(m, "L8"), f"SELECT part_txt, chip_occurrence_index, origin_fab, {_OR} FROM chipid_final WHERE lot_id = 'L8'")
add("r9_2", lambda m: R.r9_2(m, "BC18"), f"SELECT chip_occurrence_index, origin_fab, {_OR}, efuse_raw FROM chipid_final WHERE part_txt = 'BC18'")
add("r9_3", lambda m: R.r9_3(m, "L3", 2), f"SELECT {C('origin_wafer origin_x origin_y part_txt chip_occurrence_index')} FROM chipid_final WHERE origin_wafer = 2 AND origin_lot = 'L3'")
add("r9_4", lambda m: R.r9_4(m, "L8"), f"SELECT origin_fab, origin_lot, origin_wafer, count(*) AS dies, {_BAD} AS fail_dies, {pct(_BAD, 'count(*)')} AS fail_pct FROM pk GROUP BY ALL", _PKG)
add("r9_5", lambda m: R.r9_5(m, "L8"), f"SELECT {_OR}, count(*) AS dies, {_BAD} AS fails FROM pk GROUP BY ALL", _PKG)
add("r9_6", lambda m: R.r9_6(m, "L8"), "SELECT a AS die0_origin, b AS die1_origin, f AS fail_count FROM (SELECT part_txt, max(o) FILTER (WHERE i = 0) AS a, max(o) FILTER (WHERE i = 1) AS b, count(*) FILTER (WHERE NOT passed) AS f FROM (SELECT part_txt, passed, chip_occurrence_index AS i, origin_lot || ':W' || origin_wafer AS o FROM pk) GROUP BY part_txt) WHERE f > 0", _PKG)
add("r9_7", lambda m: R.r9_7(m, "L8"), f"SELECT fab_combo, count(*) AS packages, {GOOD} AS good, {pct(GOOD, 'count(*)')} AS yield_pct FROM (SELECT min(origin_fab) || '+' || max(origin_fab) AS fab_combo, bool_and(passed) AS passed FROM pk GROUP BY part_txt) GROUP BY fab_combo", _PKG)
add("r9_8", lambda m: R.r9_8(m, "L8"), f"SELECT pk.lot_id AS ft_lot, pk.part_txt AS ft_package, origin_lot AS {C('cp_lot origin_wafer origin_x origin_y d.passed')} AS cp_passed, pk.passed AS ft_passed FROM pk JOIN parts_final d ON d.passed AND NOT pk.passed AND d.lot_id = origin_lot AND d.wafer_id = 'W0' || origin_wafer AND (d.x_coord, d.y_coord) = (origin_x, origin_y)", _PKG)
add("r9_9", lambda m: R.r9_9(m, "L8"), "SELECT count(*) AS total_chipids, count(*) FILTER (WHERE NOT valid) AS invalid_efuse, count(*) FILTER (WHERE origin_fab = 'UNSUPPORTED') AS unsupported_fab FROM chipid WHERE lot_id = 'L8'")
_VAL = f"vx AS (SELECT {C('lot_id part_txt chip_occurrence_index origin_fab origin_lot origin_wafer origin_x origin_y test_num test_name units exec_seq result lo_limit hi_limit t.passed')} AS test_passed FROM test_data_final t JOIN chipid_final c USING (lot_id, part_txt) WHERE c.valid AND t.product = 'P2' AND t.test_category = 'FT' AND t.sub_process = 'FT1' AND rec_type IN ('PTR', 'MPR') AND isfinite(result) AND part_txt <> '' AND test_name ILIKE 't1%')"
add("r9_10", lambda m: R.r9_10(m, "P2", "FT1", test_name_like="t1%"), "SELECT * FROM vx", _VAL)
add("r9_10b", lambda m: R.r9_10b(R.r9_10(m, "P2", "FT1", test_name_like="t1%")), f"SELECT {_OR}, count(*) AS n, {r('avg(result)', 6)} AS mean_result, max(result) AS max_result, min(result) AS min_result FROM vx GROUP BY ALL", _VAL)
add("q_lots", R.q_lots, f"SELECT {C('lot_id product test_category sub_process start_time job_name job_rev')} FROM lots")
_LW = "lw AS (SELECT * FROM wafers QUALIFY row_number() OVER (PARTITION BY lot_id, wafer_id ORDER BY retest_num DESC) = 1)"
add("q_lot_yield", R.q_lot_yield, f"SELECT lot_id, product, sub_process, count(DISTINCT wafer_id) AS wafer_count, CAST(sum(part_count) AS BIGINT) AS total_parts, CAST(sum(good_count) AS BIGINT) AS good_parts, {pct('sum(good_count)', 'sum(part_count)')} AS yield_pct FROM lots JOIN lw USING (lot_id) GROUP BY ALL", _LW)
add("q_wafer", lambda m: R.q_wafer(m, "L0"), f"SELECT wafer_id, part_count, good_count, {pct('good_count', 'part_count')} AS yield_pct, retest_num FROM lw WHERE {_L0}", _LW)
add("q_tests", lambda m: R.q_tests(m, "L0"), f"SELECT DISTINCT {C('test_num test_name rec_type units lo_limit hi_limit')} FROM test_data_final WHERE {_L0}")
add("q_fail", lambda m: R.q_fail(m, "L1"), _RANK)
add("q_cpk", lambda m: R.q_cpk(m, "L0", "T2"), f"SELECT {TEST}, n, {r('mu', 4)} AS mean, {r('sd', 4)} AS sigma, {r('a', 4)} AS min_val, {r('z', 4)} AS max_val, {r('md', 4)} AS median, {_CP.format('sd', 'mu')} FROM (SELECT {TEST}, count(*) AS n, avg(result) AS mu, {SPREAD} AS sd, min(result) AS a, max(result) AS z, median(result) AS md FROM test_data_final WHERE lot_id = 'L0' AND test_name = 'T2' AND {LIMITED} GROUP BY ALL)")
add("q_bins", lambda m: R.q_bins(m, "L0"), _BIN.format(_L0))
add("q_bin_test", lambda m: R.q_bin_test(m, "L1"), f"SELECT {C('hard_bin soft_bin test_num test_name')}, count(*) AS fail_count FROM (SELECT * FROM parts_final WHERE NOT passed) JOIN (SELECT * FROM test_data_final WHERE passed = 'F') USING ({_ON}) WHERE lot_id = 'L1' GROUP BY ALL")
add("q_csv", lambda m: R.q_csv(m, ["L2"]), _EXPORT.replace("('L0', 'L8')", "('L2')"))

# -- decoding and predicates

_BITS = "eb AS (SELECT record_no, lpad(bin(CAST(record_no AS BIGINT) * 1000003 * 7919), 64, '0') AS e FROM parts WHERE retest_num = 0)"


def _efuse(m: Model) -> DataFrame:
    e = F.lpad(F.bin(F.col("record_no") * 1000003 * 7919), 64, "0")
    d = decode_efuse(e)
    return m.parts.where("retest_num = 0").select("record_no", *[d[k].alias(k) for k in cols("valid origin_fab origin_lot origin_wafer origin_x origin_y reserved_bits")])


def _slice(i: int, n: int) -> str:
    return f"CAST('0b' || substr(e, {i + 1}, {n}) AS BIGINT)"


_LOT = "substr('___ABCDEFGHIJKLMNOPQRSTUVWXYZ___', CAST(" + _slice(27, 5) + " AS INT) + 1, 1) || " + " || ".join(f"substr(repeat('_', 14) || '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ' || repeat('_', 14), CAST({_slice(32 + 6 * i, 6)} AS INT) + 1, 1)" for i in range(5))
add("efuse_decode", _efuse, f"SELECT record_no, true AS valid, CASE {_slice(0, 4)} WHEN 1 THEN 'TSMC1' WHEN 6 THEN 'TSMC2' ELSE 'UNSUPPORTED' END AS origin_fab, {_LOT} AS origin_lot, {_slice(22, 5)} - 3 AS origin_wafer, {_slice(13, 9)} AS origin_x, {_slice(4, 9)} AS origin_y, substr(e, 63, 2) AS reserved_bits FROM eb", _BITS)
add("finite_ilike_regex", lambda m: m.test_data_final.where(finite("result") & F.col("test_name").ilike("t%") & F.col("units").rlike("^m?[VA]$")).groupBy("lot_id", "units").agg(F.count(F.lit(1)).alias("n")), "SELECT lot_id, units, count(*) AS n FROM test_data_final WHERE isfinite(result) AND test_name ILIKE 't%' AND regexp_matches(units, '^m?[VA]$') GROUP BY ALL")
