"""The report catalog, numbered as in the user guide: one function a report.

Every function takes a ``Model`` and its parameters and returns a lazy DataFrame.
Filters on lot and test reach the scan; nothing is collected inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silicore.functions.expr import cols, NO_COORD, capability, fail_count, finite, good_count, measured, package_text, percent, rounded, shown_digits, sig_digits
from silicore.plans.views import Model


def _n() -> Column:
    return F.count(F.lit(1))



def _is(**values) -> Column:
    out = F.lit(True)
    for c, v in values.items():
        out = out & (F.col(c) == v)
    return out


def _yield(df: DataFrame, *keys, extra: Sequence[Column] = ()) -> DataFrame:
    """dies, good and yield_pct by keys."""
    per = df.groupBy(*keys).agg(*extra, _n().alias("dies"), good_count().alias("good"))
    return per.withColumn("yield_pct", percent("good", "dies"))


def _place(df: DataFrame) -> DataFrame:
    """``df`` with the die's identity as one extra column, to join on."""
    return df.withColumn("__text", package_text())


PLACE = [*cols("lot_id wafer_id x_coord y_coord __text")]


# -- 1: programs


def r1_1(m: Model) -> DataFrame:
    keys = cols("product sub_process job_name job_rev")
    return m.lots.select(*keys).distinct().orderBy(*keys)


def r1_2(m: Model) -> DataFrame:
    return m.lots.groupBy("product", "sub_process", "job_name", "job_rev").agg(F.max("start_time").alias("last_used")).orderBy(F.desc("last_used"))


def r1_3(m: Model, lot: str) -> DataFrame:
    return m.lots.where(_is(lot_id=lot)).select("lot_id", *cols("product sub_process job_name job_rev tester_type operator start_time finish_time"))


def r1_4(m: Model, lot: str) -> DataFrame:
    head = m.lots.where(_is(lot_id=lot)).select("lot_id", *cols("product sub_process job_name job_rev tester_type operator"))
    die = m.parts_final.where(_is(lot_id=lot)).select("lot_id", *cols("part_id wafer_id part_txt x_coord y_coord hard_bin soft_bin"), F.col("passed").alias("die_passed"), "retest_num")
    test = m.test_data_final.where(_is(lot_id=lot)).select("lot_id", *cols("part_id test_num test_name rec_type result lo_limit hi_limit units"), F.col("passed").alias("test_passed"))
    return head.join(die, "lot_id").join(test, ["lot_id", "part_id"]).orderBy("wafer_id", "part_id", "test_num")


# -- 2: lots


def r2_1(m: Model, product: str, sub_process: str) -> DataFrame:
    return m.lots.where(_is(product=product, sub_process=sub_process)).select("lot_id", *cols("product sub_process start_time finish_time job_name job_rev")).orderBy(F.desc_nulls_last("start_time"))


def r2_2(m: Model, begin: str, end: str) -> DataFrame:
    t = dict(m.lots.dtypes)["start_time"]
    return m.lots.where((F.col("start_time") >= F.lit(begin).cast(t)) & (F.col("start_time") < F.lit(end).cast(t))).orderBy(F.asc_nulls_last("start_time"))


def r2_3(m: Model) -> DataFrame:
    keys = [*cols("lot_id product test_category sub_process job_name")]
    return _yield(m.lots.select(*keys).join(m.parts_final.select("lot_id", "passed"), "lot_id"), *keys).orderBy("product", "test_category", "yield_pct")


# -- 3: wafers


def r3_1(m: Model, lot: str) -> DataFrame:
    return _yield(m.parts_final.where(_is(lot_id=lot)), "wafer_id").orderBy("yield_pct", "wafer_id")


def r3_2(m: Model, lot: str, below: float = 90.0) -> DataFrame:
    return r3_1(m, lot).where(F.col("yield_pct") < below)


def r3_3(m: Model, lot: str) -> DataFrame:
    told = m.latest_wafers.where(_is(lot_id=lot)).select("wafer_id", F.col("good_count").alias("wrr_good"), F.col("part_count").alias("wrr_total"))
    seen = m.parts_final.where(_is(lot_id=lot)).groupBy("wafer_id").agg(good_count().alias("parts_good"), _n().alias("parts_total"))
    out = told.join(seen, "wafer_id").withColumns({"wrr_yield": percent("wrr_good", "wrr_total"), "parts_yield": percent("parts_good", "parts_total")})
    return out.orderBy(F.desc(F.abs(F.col("wrr_yield") - F.col("parts_yield"))), "wafer_id")


def r3_4(m: Model, lot: str, wafer: str) -> DataFrame:
    return m.parts_final.where(_is(lot_id=lot, wafer_id=wafer)).select("x_coord", *cols("y_coord hard_bin soft_bin passed")).orderBy("y_coord", "x_coord")


def r3_5(m: Model, lot: str, wafer: str, inner: float = 50, outer: float = 90) -> DataFrame:
    x, y = F.col("x_coord").cast("double"), F.col("y_coord").cast("double")
    r = F.sqrt(x * x + y * y)
    zone = F.when(r <= inner, "1_center").when(r <= outer, "2_middle").otherwise("3_edge")
    return _yield(m.parts_final.where(_is(lot_id=lot, wafer_id=wafer)).withColumn("zone", zone), "zone").orderBy("zone")


# -- 4: dies and bins


def r4_1(m: Model, lot: str, wafer: str) -> DataFrame:
    return m.parts_final.where(_is(lot_id=lot, wafer_id=wafer) & ~F.col("passed")).select("part_id", *cols("x_coord y_coord hard_bin soft_bin test_count test_time")).orderBy("hard_bin", "soft_bin")


def _bins(df: DataFrame) -> DataFrame:
    per = df.groupBy("hard_bin", "soft_bin").agg(_n().alias("die_count"))
    return per.withColumn("pct", percent("die_count", F.sum("die_count").over(Window.partitionBy())))


def r4_2(m: Model, lot: str, wafer: str) -> DataFrame:
    return _bins(m.parts_final.where(_is(lot_id=lot, wafer_id=wafer))).orderBy("hard_bin", "soft_bin")


def r4_3(m: Model, lot: str) -> DataFrame:
    """Pareto of failing soft bins; bins of one count share a cumulative percentage."""
    per = m.parts_final.where(_is(lot_id=lot) & ~F.col("passed")).groupBy("soft_bin").agg(_n().alias("die_count"))
    whole = F.sum("die_count").over(Window.partitionBy())
    run = F.sum("die_count").over(Window.orderBy(F.desc("die_count")).rangeBetween(Window.unboundedPreceding, 0))
    return per.select("soft_bin", "die_count", percent("die_count", whole).alias("pct"), percent(run, whole).alias("cumulative_pct")).orderBy(F.desc("die_count"), "soft_bin")


def r4_4(m: Model, lot: str, wafer: str) -> DataFrame:
    """Failing dies beside failing dies: each die names its four neighbours, an equi-join
    where comparing distances would compare all pairs."""
    fail = m.parts_final.where(_is(lot_id=lot, wafer_id=wafer) & ~F.col("passed")).select("x_coord", "y_coord")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = fail.withColumn("d", F.explode(steps)).select("x_coord", "y_coord", (F.col("x_coord") + F.col("d.dx")).alias("nx"), (F.col("y_coord") + F.col("d.dy")).alias("ny"))
    there = fail.select(F.col("x_coord").alias("nx"), F.col("y_coord").alias("ny"))
    return near.join(there, ["nx", "ny"]).groupBy("x_coord", "y_coord").agg(_n().alias("fail_neighbors")).orderBy(F.desc("fail_neighbors"), "y_coord", "x_coord")


# -- 5: measurements

TEST = [*cols("test_num test_name units lo_limit hi_limit")]


def r5_1(m: Model, lot: str, test: str) -> DataFrame:
    stats = {"avg_val": F.avg("result"), "stddev_val": F.stddev_samp("result"), "min_val": F.min("result"), "max_val": F.max("result"), "median_val": F.median("result"), "q1": F.percentile("result", F.lit(0.25)), "q3": F.percentile("result", F.lit(0.75))}
    return m.test_data_final.where(_is(lot_id=lot, test_name=test)).groupBy(*TEST).agg(_n().alias("cnt"), *[rounded(c, 4).alias(n) for n, c in stats.items()])


def r5_2(m: Model, lot: str, wafer: str) -> DataFrame:
    return m.test_data_final.where(_is(lot_id=lot, wafer_id=wafer, passed="F")).select("part_id", *cols("x_coord y_coord test_num test_name result lo_limit hi_limit units")).orderBy("test_num", "part_id")


def r5_3(m: Model, lot: str) -> DataFrame:
    per = m.test_data_final.where(_is(lot_id=lot)).groupBy("test_num", "test_name").agg(_n().alias("total"), fail_count().alias("fail_cnt")).where("fail_cnt > 0")
    return per.withColumn("fail_pct", percent("fail_cnt", "total")).orderBy(F.desc("fail_pct"), "test_num", "test_name")


def r5_4(m: Model, lot: str, part: str) -> DataFrame:
    return m.test_data_final.where(_is(lot_id=lot, part_id=part)).select("test_num", *cols("test_name rec_type result lo_limit hi_limit units passed")).orderBy("test_num")


def _limited(m: Model, lot: str) -> DataFrame:
    return m.test_data_final.where(_is(lot_id=lot) & F.col("lo_limit").isNotNull() & F.col("hi_limit").isNotNull() & F.col("rec_type").isin("PTR", "MPR"))


def r5_5(m: Model, lot: str) -> DataFrame:
    per = _limited(m, lot).groupBy(*TEST).agg(F.avg("result").alias("mu"), _n().alias("n")).where("n > 1")
    margin = F.try_divide(100.0 * F.least(F.col("mu") - F.col("lo_limit"), F.col("hi_limit") - F.col("mu")), F.col("hi_limit") - F.col("lo_limit"))
    return per.select(*TEST, rounded("mu", 4).alias("mean"), rounded(margin, 2).alias("margin_pct")).orderBy(F.asc_nulls_last("margin_pct"), "test_num")


def r5_6(m: Model, lot: str, test: str, sigmas: float = 3.0) -> DataFrame:
    """Values beyond three sample sigmas. The statistics have a row a test number."""
    rows = m.test_data_final.where(_is(lot_id=lot, test_name=test))
    stat = rows.groupBy("test_num").agg(F.avg("result").alias("mu"), F.stddev_samp("result").alias("sigma"))
    off = F.col("result") - F.col("mu")
    out = rows.join(stat, "test_num").where(F.abs(off) > sigmas * F.col("sigma"))
    return out.select("part_id", "x_coord", "y_coord", "result", rounded(F.try_divide(off, F.col("sigma")), 2).alias("z_score"), F.abs(off).alias("__o")).orderBy(F.desc("__o")).drop("__o")


def r5_7(m: Model, lot: str, test: str) -> DataFrame:
    site = m.parts_final.where(_is(lot_id=lot)).select("part_id", "site_num")
    rows = m.test_data_final.where(_is(lot_id=lot, test_name=test)).select("part_id", "test_name", "result")
    return rows.join(site, "part_id").groupBy("site_num", "test_name").agg(_n().alias("n"), rounded(F.avg("result"), 4).alias("mean"), rounded(F.stddev_samp("result"), 4).alias("sigma")).orderBy("site_num")


def r5_8(m: Model, lot: str, test_a: str, test_b: str) -> DataFrame:
    rows = m.test_data_final.where(_is(lot_id=lot) & F.col("test_name").isin(test_a, test_b))
    wide = rows.groupBy("part_id").agg(*[F.max(F.when(F.col("test_name") == t, F.col("result"))).alias(n) for t, n in ((test_a, "a"), (test_b, "b"))]).where("a IS NOT NULL AND b IS NOT NULL")
    cov, va = F.covar_pop("a", "b"), F.var_pop("a")
    slope = F.try_divide(cov, va)
    r = F.try_divide(cov, F.stddev_pop("a") * F.stddev_pop("b"))
    return wide.agg(_n().alias("n"), rounded(r, 4).alias("pearson_r"), rounded(slope, 6).alias("slope"), rounded(F.avg("b") - slope * F.avg("a"), 6).alias("intercept"))


def r5_9(m: Model, lot: str, test: str) -> DataFrame:
    return m.test_data_final.where(_is(lot_id=lot, rec_type="MPR", test_name=test)).groupBy("pin_num", "pin_name", "units").agg(_n().alias("n"), rounded(F.avg("result"), 4).alias("mean"), rounded(F.stddev_samp("result"), 4).alias("sigma")).orderBy(F.asc_nulls_last("pin_num"))


# -- 6: retests


def r6_1(m: Model, lot: str) -> DataFrame:
    return m.parts_final.where(_is(lot_id=lot)).groupBy("retest_num").agg(_n().alias("dies")).orderBy("retest_num")


def r6_2(m: Model, lot: str) -> DataFrame:
    on = [*cols("lot_id wafer_id x_coord y_coord part_txt")]
    was = m.parts.where(_is(lot_id=lot, retest_num=0)).select(*on, F.col("passed").alias("p0"))
    now = m.parts_final.where(_is(lot_id=lot)).select(*on, F.col("passed").alias("p1"))
    return was.join(now, on).agg(_n().alias("dies"), good_count("p0").alias("good_run0"), good_count("p1").alias("good_final"), F.count(F.when(~F.col("p0") & F.col("p1"), 1)).alias("recovered_by_retest"))


def r6_3(m: Model, lot: str) -> DataFrame:
    return m.parts_final.where(_is(lot_id=lot) & ~F.col("passed") & (F.col("retest_num") > 0)).select("wafer_id", *cols("part_txt x_coord y_coord hard_bin soft_bin retest_num")).orderBy("wafer_id", "y_coord", "x_coord")


# -- 7: across lots


def r7_1(m: Model, product: str) -> DataFrame:
    rows = m.lots.where(_is(product=product)).select("lot_id", "product", "sub_process", F.date_trunc("day", "start_time").alias("test_date")).join(m.parts_final.select("lot_id", "passed"), "lot_id")
    return _yield(rows, "test_date", "product", "sub_process", extra=[F.countDistinct("lot_id").alias("lot_count")]).orderBy("test_date")


def r7_2(m: Model) -> DataFrame:
    rows = m.lots.select("lot_id", "tester_type", "operator").join(m.parts_final.select("lot_id", "passed"), "lot_id")
    return _yield(rows, "tester_type", "operator", extra=[F.countDistinct("lot_id").alias("lot_count")]).orderBy("yield_pct")


def r7_3(m: Model, lot: str) -> DataFrame:
    """Failing tests of each bin: dies that fail the test, and dies that fail it alone."""
    die = _place(m.parts_final.where(_is(lot_id=lot) & ~F.col("passed"))).select(*PLACE, "hard_bin", "soft_bin")
    test = _place(m.test_data_final.where(_is(lot_id=lot, passed="F"))).select(*PLACE, "test_num", "test_name")
    # One row a die with its tests; a bin's dies are counted at the first test of each.
    fail = die.join(test, PLACE).groupBy("wafer_id", *cols("x_coord y_coord __text hard_bin soft_bin")).agg(F.collect_set(F.struct("test_num", "test_name")).alias("tests"))
    each = fail.select("wafer_id", "hard_bin", "soft_bin", F.size(F.array_distinct("tests.test_num")).alias("n_tests"), F.posexplode("tests").alias("at", "test"))
    per = each.groupBy("wafer_id", "hard_bin", "soft_bin", "test.test_num", "test.test_name").agg(_n().alias("fail_dies"), F.count(F.when(F.col("n_tests") == 1, 1)).alias("sole_fail_dies"), F.count(F.when(F.col("at") == 0, 1)).alias("first"))
    out = per.withColumn("pct_of_bin", percent("fail_dies", F.sum("first").over(Window.partitionBy("wafer_id", "soft_bin")), 1))
    return out.select("wafer_id", *cols("hard_bin soft_bin test_num test_name fail_dies sole_fail_dies pct_of_bin")).orderBy("wafer_id", "soft_bin", F.desc("fail_dies"), "test_num")


def r7_4(m: Model, lot: str) -> DataFrame:
    test = _place(m.test_data_final.where(_is(lot_id=lot, passed="F"))).select(*PLACE, *cols("part_txt test_num test_name rec_type exec_seq result lo_limit hi_limit units"))
    die = _place(m.parts_final.where(_is(lot_id=lot))).select(*PLACE, "hard_bin", "soft_bin", F.col("passed").alias("die_passed"))
    return test.join(die, PLACE, "left").drop("__text").orderBy(F.asc_nulls_last("soft_bin"), *cols("wafer_id x_coord y_coord test_num exec_seq"))


def r7_5(m: Model, lots: Sequence[str]) -> DataFrame:
    rows = m.lots.where(F.col("lot_id").isin(*lots)).select("lot_id", "job_rev").join(m.parts_final.select("lot_id", "passed"), "lot_id")
    return _yield(rows, "lot_id", "job_rev").orderBy(F.desc("yield_pct"), "lot_id")


# -- 8: specifications


def r8_1(m: Model, lot: str) -> DataFrame:
    mu, sd = F.avg("result"), F.stddev_samp("result")
    per = _limited(m, lot).groupBy(*TEST).agg(_n().alias("n"), mu.alias("mu"), sd.alias("sd")).where("n > 1 AND sd > 0")
    mu, sd, lo, hi = (F.col(c) for c in cols("mu sd lo_limit hi_limit"))
    return per.select(*TEST, "n", rounded(mu, 6).alias("mean"), rounded(sd, 6).alias("sigma"), rounded((hi - lo) / (6.0 * sd), 3).alias("cp"), rounded(capability(mu, sd, lo, hi), 3).alias("cpk")).orderBy("cpk", "test_num")


def _targets(m: Model, product: str, test_category: str, sub_process: str, job_name: str | None, job_rev: str | None, exclude_lot: str | None) -> DataFrame:
    cond = _is(product=product, test_category=test_category, sub_process=sub_process)
    if job_name is not None:
        cond &= F.col("job_name") == job_name
    if job_rev is not None:
        cond &= F.col("job_rev") == job_rev
    if exclude_lot is not None:
        cond &= ~F.col("lot_id").like(exclude_lot)
    return m.lots.where(cond).select("lot_id", "job_name", "job_rev", "start_time")


def _scope(m: Model, product: str, test_category: str, sub_process: str) -> DataFrame:
    return m.test_data_final.where(_is(product=product, test_category=test_category, sub_process=sub_process))


def _named(df: DataFrame, test_name_like: str | None) -> DataFrame:
    return df if test_name_like is None else df.where(F.col("test_name").ilike(test_name_like))


def _current_spec(m: Model, scope: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last started lot (one row), and the limits that its tests had."""
    ref = targets.orderBy(F.desc_nulls_last("start_time"), F.desc("lot_id")).limit(1)
    spec = scope.where(measured(units=False)).join(F.broadcast(ref.select("lot_id")), "lot_id", "left_semi")
    return ref, spec.groupBy("test_num").agg(F.min("lo_limit").alias("cur_lsl"), F.min("hi_limit").alias("cur_usl"))


def r8_2(m: Model, product: str, test_category: str, sub_process: str, cpk_min: float = 1.33, cpk_max: float = 3.0, min_n: int = 30, test_name_like: str | None = None, job_name: str | None = None, job_rev: str | None = None, exclude_lot: str | None = None) -> DataFrame:
    """Review of limits: where Cpk falls short of cpk_min, limits that lie between the
    cpk_min and the cpk_max band around what was measured, three significant digits outwards."""
    targets = _targets(m, product, test_category, sub_process, job_name, job_rev, exclude_lot)
    ref = targets.orderBy(F.desc_nulls_last("start_time"), F.desc("lot_id")).limit(1)
    one = ref.select(F.col("lot_id").alias("ref_lot_id"), F.col("job_name").alias("latest_job_name"), F.col("job_rev").alias("latest_job_rev"))
    # One pass: the last lot's limits are aggregated beside the statistics that all lots give.
    rows = _scope(m, product, test_category, sub_process).where(measured(units=False)).join(targets.select("lot_id"), "lot_id", "left_semi").crossJoin(F.broadcast(one))
    counts = measured() if test_name_like is None else measured() & F.col("test_name").ilike(test_name_like)
    of = lambda c: F.when(counts, F.col(c))
    now = lambda c: F.min(F.when(F.col("lot_id") == F.col("ref_lot_id"), F.col(c)))
    df = rows.groupBy("test_num", *cols("ref_lot_id latest_job_name latest_job_rev")).agg(
        F.min(of("test_name")).alias("test_name"), F.min(of("units")).alias("units"), F.count(of("result")).alias("n"), F.count(F.when(counts & (F.col("passed") == "F"), 1)).alias("fail_n"), F.avg(of("result")).alias("mu"), F.stddev_samp(of("result")).alias("sd"),
        F.min(of("result")).alias("lo"), F.max(of("result")).alias("hi"), ((F.min(of("lo_limit")) != F.max(of("lo_limit"))) | (F.min(of("hi_limit")) != F.max(of("hi_limit")))).alias("limits_changed"),
        now("lo_limit").alias("cur_lsl"), now("hi_limit").alias("cur_usl"),
    ).where(F.col("n") > 1).where(finite("sd") & (F.col("sd") > 0))
    mu, sd, lsl, usl = (F.col(c) for c in cols("mu sd cur_lsl cur_usl"))
    near, far = 3.0 * cpk_min, 3.0 * cpk_max
    df = df.withColumns({
        "d": shown_digits(F.nullif(F.abs(mu), F.lit(0.0)), sd),
        "w_lsl": sig_digits(mu - near * sd, up=False), "t_lsl": sig_digits(mu - far * sd, up=False),
        "w_usl": sig_digits(mu + near * sd, up=True), "t_usl": sig_digits(mu + far * sd, up=True),
    })
    df = df.withColumns({"n_lsl": F.greatest(F.least(lsl, F.col("w_lsl")), F.col("t_lsl")), "n_usl": F.least(F.greatest(usl, F.col("w_usl")), F.col("t_usl"))})
    nl, nu, none = F.col("n_lsl"), F.col("n_usl"), lsl.isNull() | usl.isNull()
    direction = F.when(none, "NO_BASELINE").when((nl < lsl) & (nu > usl), "LOOSEN").when((nl > lsl) & (nu < usl), "TIGHTEN").when((nl == lsl) & (nu == usl), "NO_CHANGE").otherwise("MIXED")
    flags = F.concat_ws(",", F.when(F.col("n") < min_n, "LOW_SAMPLE"), F.when(none, "NOT_IN_LATEST_LOT"), F.when(F.col("limits_changed"), "LIMIT_CHANGED"))
    show = lambda c: rounded(c, F.col("d"))
    out = df.select(
        *cols("test_num test_name units n fail_n"), percent("fail_n", "n", 3).alias("fail_pct"), show(mu).alias("mean"), show(sd).alias("sigma"), show("lo").alias("min_val"), show("hi").alias("max_val"),
        "ref_lot_id", "latest_job_name", "latest_job_rev", show(lsl).alias("cur_lsl"), show(usl).alias("cur_usl"), "limits_changed", rounded((usl - lsl) / (6.0 * sd), 3).alias("cp_current"),
        F.when(~none, rounded(capability(mu, sd, lsl, usl), 3)).alias("cpk_current"), show(nl).alias("new_lsl"), show(nu).alias("new_usl"), show(nl - lsl).alias("lsl_change"), show(nu - usl).alias("usl_change"), direction.alias("direction"), flags.alias("flags"),
    )
    return out.where(F.col("cpk_current").isNull() | (F.col("cpk_current") < cpk_min)).orderBy(F.asc_nulls_last("cpk_current"), "test_num")


def r8_2b(m: Model) -> DataFrame:
    """Tests that go by several names."""
    per = m.test_data_final.select("test_num", "test_name").distinct().groupBy("test_num").agg(F.countDistinct("test_name").alias("name_variants"), F.array_join(F.array_sort(F.collect_set("test_name")), ", ").alias("names"))
    return per.where("name_variants > 1").orderBy("test_num")


DUMP = [*cols("lot_id wafer_id x_coord y_coord part_txt job_name job_rev test_num test_name units rec_type exec_seq result lo_limit hi_limit test_passed")]
_DUMP_ORDER = [*cols("test_num lot_id wafer_id x_coord y_coord exec_seq")]


def r8_3(m: Model, product: str, test_category: str, sub_process: str, test_name_like: str | None = None, job_name: str | None = None, job_rev: str | None = None, exclude_lot: str | None = None) -> DataFrame:
    """The rows that ``r8_2`` is computed from."""
    targets = _targets(m, product, test_category, sub_process, job_name, job_rev, exclude_lot).drop("start_time")
    rows = _named(_scope(m, product, test_category, sub_process).where(measured()), test_name_like).withColumnRenamed("passed", "test_passed")
    return rows.join(targets, "lot_id").select(*DUMP).orderBy(*_DUMP_ORDER)


def r8_3b(dump: DataFrame) -> DataFrame:
    """Counts and moments of a dump, to reconcile with ``r8_2``."""
    per = dump.groupBy("test_num").agg(_n().alias("n"), fail_count("test_passed").alias("fail_n"), F.avg("result").alias("mu"), F.stddev_samp("result").alias("sd"))
    mu, sd = F.col("mu"), F.col("sd")
    return per.select("test_num", "n", "fail_n", rounded(mu, shown_digits(F.nullif(F.abs(mu), F.lit(0.0)))).alias("mean"), rounded(sd, shown_digits(F.nullif(sd, F.lit(0.0)))).alias("sigma")).orderBy("test_num")


def review_table(df: DataFrame) -> DataFrame:
    """A CSV of revised limits as (test_num, rev_lsl, rev_usl, csv_rows); other columns do not count."""
    c = lambda n, t: F.expr(f"try_cast({n} AS {t})")
    return df.select(c("test_num", "bigint").alias("test_num"), c("rev_lsl", "double").alias("l"), c("rev_usl", "double").alias("u")).groupBy("test_num").agg(F.min("l").alias("rev_lsl"), F.min("u").alias("rev_usl"), _n().alias("csv_rows"))


def _checked(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` to be broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def r8_4(m: Model, review: DataFrame, product: str, test_category: str, sub_process: str, target_cpk: float = 1.33, test_name_like: str | None = None, job_name: str | None = None, job_rev: str | None = None, exclude_lot: str | None = None) -> DataFrame:
    """What revised limits would do: Cpk, failures, and dies that would newly fail."""
    targets = _targets(m, product, test_category, sub_process, job_name, job_rev, exclude_lot)
    scope = _scope(m, product, test_category, sub_process)
    base = _named(scope.where(measured()), test_name_like).join(targets.select("lot_id"), "lot_id", "left_semi").select("test_num", *cols("test_name units result passed"))
    _, spec = _current_spec(m, scope, targets)
    # A row a test: as long as they are few, the measurements are not shuffled by test, of which there are few and unequal ones.
    rows = base.join(_checked(review_table(review).join(spec, "test_num", "full")), "test_num", "left")
    out_rev = (F.col("result") < F.col("rev_lsl")) | (F.col("result") > F.col("rev_usl"))
    was_in = (F.col("result") >= F.col("cur_lsl")) & (F.col("result") <= F.col("cur_usl"))
    keys = [*cols("cur_lsl cur_usl rev_lsl rev_usl csv_rows")]
    a = rows.groupBy("test_num").agg(
        F.min("test_name").alias("test_name"), F.min("units").alias("units"), _n().alias("n"), F.avg("result").alias("mu"), F.stddev_samp("result").alias("sd"), F.min("result").alias("lo"), F.max("result").alias("hi"),
        *[F.max(k).alias(k) for k in keys], fail_count().alias("fail_n_cur"), F.count(F.when(out_rev, 1)).alias("f_rev"), F.count(F.when(was_in & out_rev, 1)).alias("f_new"),
    )
    mu, sd, lsl, usl = (F.col(c) for c in cols("mu sd rev_lsl rev_usl"))
    no_rev, no_cur = lsl.isNull() | usl.isNull(), F.col("cur_lsl").isNull() | F.col("cur_usl").isNull()
    a = a.withColumns({"cpk": capability(mu, sd, lsl, usl), "d": shown_digits(F.nullif(F.abs(mu), F.lit(0.0)), F.nullif(sd, F.lit(0.0))), "fail_n_rev": F.when(~no_rev, F.col("f_rev")), "n_newly_fail": F.when(~no_rev & ~no_cur, F.col("f_new"))})
    show = lambda c: rounded(c, F.col("d"))
    flags = F.concat_ws(",", *[F.when(c, n) for n, c in (
        ("MISSING_IN_CSV", no_rev), ("NO_CURRENT_SPEC", no_cur), ("DUP_IN_CSV", F.col("csv_rows") > 1), ("INVERTED", lsl >= usl), ("OUTSIDE_MEASURED", (F.col("lo") < lsl) | (F.col("hi") > usl)), ("CPK_SHORT", F.col("cpk") < target_cpk),
    )])
    return a.select(
        *cols("test_num test_name units n"), show(mu).alias("mean"), show(sd).alias("sigma"), show("lo").alias("min_val"), show("hi").alias("max_val"), show("cur_lsl").alias("cur_lsl"), show("cur_usl").alias("cur_usl"), "rev_lsl", "rev_usl",
        rounded("cpk", 3).alias("cpk_rev"), "fail_n_cur", "fail_n_rev", "n_newly_fail", rounded(F.try_divide(1e6 * F.col("fail_n_rev"), F.col("n").cast("double")), 1).alias("fail_ppm_rev"), flags.alias("flags"),
    ).orderBy(F.desc_nulls_last("n_newly_fail"), F.asc_nulls_first("cpk_rev"), "test_num")


def r8_4b(dump: DataFrame, review: DataFrame) -> DataFrame:
    """The rows of a dump that pass now and would fail revised limits."""
    out = dump.join(_checked(review_table(review).drop("csv_rows")), "test_num").where(F.col("result").between(F.col("lo_limit"), F.col("hi_limit")) & ((F.col("result") < F.col("rev_lsl")) | (F.col("result") > F.col("rev_usl"))))
    return out.select("lot_id", *cols("wafer_id x_coord y_coord part_txt test_num test_name result lo_limit hi_limit rev_lsl rev_usl")).orderBy("test_num", "lot_id", "wafer_id")


def r8_5(m: Model, names: DataFrame, product: str, test_category: str, sub_process: str, **where) -> DataFrame:
    """``r8_3`` for the tests that a list (test_name) names."""
    return r8_3(m, product, test_category, sub_process, **where).join(names.select("test_name").distinct(), "test_name", "left_semi").select(*DUMP).orderBy(*_DUMP_ORDER)


def r8_5b(dump: DataFrame, names: DataFrame) -> DataFrame:
    """Listed tests that the dump does not hold."""
    return names.select("test_name").distinct().join(dump.select("test_name"), "test_name", "left_anti").orderBy("test_name")


def limit_variants(m: Model, product: str, test_category: str, sub_process: str, job_name: str | None = None, job_rev: str | None = None, exclude_lot: str | None = None) -> DataFrame:
    """A row a test and run: its name, limits and program."""
    targets = _targets(m, product, test_category, sub_process, job_name, job_rev, exclude_lot).drop("start_time")
    per = _scope(m, product, test_category, sub_process).where(F.col("rec_type").isin("PTR", "MPR")).groupBy("test_num", "lot_id", "wafer_id", "retest_num")
    per = per.agg(F.min("test_name").alias("test_name"), F.min("units").alias("units"), F.min("lo_limit").alias("lo"), F.min("hi_limit").alias("hi")).join(targets, "lot_id")
    text = lambda c: F.coalesce(F.when(F.col(c) == F.floor(c), F.concat(F.col(c).cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.col(c).cast("string")), F.lit("NULL"))
    return per.withColumn("limit_pair", F.concat(text("lo"), F.lit(" / "), text("hi")))


def r8_6a(variants: DataFrame) -> DataFrame:
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    per = variants.groupBy("test_num").agg(F.min("test_name").alias("test_name"), _n().alias("files"), F.countDistinct("limit_pair").alias("limit_variants"), F.countDistinct("test_name").alias("name_variants"), joined("limit_pair", "  |  ").alias("variants"), joined(F.concat_ws("/", "job_name", "job_rev"), ", ").alias("jobs"))
    return per.where("limit_variants > 1 OR name_variants > 1").orderBy(F.desc("limit_variants"), F.desc("name_variants"), "test_num")


def r8_6b(variants: DataFrame, test_num: int) -> DataFrame:
    per = variants.where(_is(test_num=test_num)).groupBy("limit_pair", "job_name", "job_rev", "units")
    return per.agg(_n().alias("files"), F.array_join(F.array_sort(F.collect_set("lot_id")), ", ").alias("lots"), F.min("wafer_id").alias("wafer_min"), F.max("wafer_id").alias("wafer_max")).orderBy(F.desc("files"))


# -- 9: where a die came from


def r9_1(m: Model, lot: str) -> DataFrame:
    return m.chipid_final.where(_is(lot_id=lot)).select("part_txt", *cols("chip_occurrence_index origin_fab origin_lot origin_wafer origin_x origin_y")).orderBy("part_txt", "chip_occurrence_index")


def r9_2(m: Model, barcode: str) -> DataFrame:
    return m.chipid_final.where(_is(part_txt=barcode)).select("chip_occurrence_index", *cols("origin_fab origin_lot origin_wafer origin_x origin_y efuse_raw")).orderBy("chip_occurrence_index")


def r9_3(m: Model, origin_lot: str, origin_wafer: int) -> DataFrame:
    return m.chipid_final.where(_is(origin_lot=origin_lot, origin_wafer=origin_wafer)).select("origin_wafer", *cols("origin_x origin_y part_txt chip_occurrence_index")).orderBy("origin_x", "origin_y")


def _chips(m: Model, lot: str) -> DataFrame:
    """Valid chips of a final-test lot with their package's verdict."""
    part = m.parts_final.where(_is(lot_id=lot)).select("part_txt", "passed")
    return m.chipid_final.where(_is(lot_id=lot) & F.col("valid")).join(part, "part_txt")


def r9_4(m: Model, lot: str) -> DataFrame:
    per = _chips(m, lot).groupBy("origin_fab", "origin_lot", "origin_wafer").agg(_n().alias("dies"), F.count(F.when(~F.col("passed"), 1)).alias("fail_dies"))
    return per.withColumn("fail_pct", percent("fail_dies", "dies")).orderBy(F.desc("fail_pct"))


def r9_5(m: Model, lot: str) -> DataFrame:
    return _chips(m, lot).groupBy("origin_lot", "origin_wafer", "origin_x", "origin_y").agg(_n().alias("dies"), F.count(F.when(~F.col("passed"), 1)).alias("fails")).orderBy(F.desc("fails"))


def r9_6(m: Model, lot: str) -> DataFrame:
    origin = F.concat(F.col("origin_lot"), F.lit(":W"), F.col("origin_wafer").cast("string"))
    per = _chips(m, lot).withColumn("o", origin).groupBy("part_txt").agg(*[F.max(F.when(F.col("chip_occurrence_index") == i, F.col("o"))).alias(f"die{i}_origin") for i in (0, 1)], F.count(F.when(~F.col("passed"), 1)).alias("fail_count"))
    return per.where("fail_count > 0").drop("part_txt")


def r9_7(m: Model, lot: str) -> DataFrame:
    pkg = _chips(m, lot).groupBy("part_txt").agg(F.concat(F.min("origin_fab"), F.lit("+"), F.max("origin_fab")).alias("fab_combo"), F.bool_and("passed").alias("passed"))
    per = pkg.groupBy("fab_combo").agg(_n().alias("packages"), good_count().alias("good"))
    return per.withColumn("yield_pct", percent("good", "packages")).orderBy("yield_pct")


def r9_8(m: Model, lot: str) -> DataFrame:
    """Dies that passed at wafer test in packages that failed at final test."""
    chip = _chips(m, lot).where(~F.col("passed")).select(F.col("lot_id").alias("ft_lot"), F.col("part_txt").alias("ft_package"), F.col("origin_lot").alias("cp_lot"), "origin_wafer", "origin_x", "origin_y", F.col("passed").alias("ft_passed"))
    chip = chip.withColumn("__w", F.concat(F.lit("W"), F.lpad(F.col("origin_wafer").cast("string"), 2, "0")))
    die = m.parts_final.where(F.col("passed")).select(F.col("lot_id").alias("cp_lot"), F.col("wafer_id").alias("__w"), F.col("x_coord").alias("origin_x"), F.col("y_coord").alias("origin_y"), F.col("passed").alias("cp_passed"))
    return chip.join(die, [*cols("cp_lot __w origin_x origin_y")]).select("ft_lot", *cols("ft_package cp_lot origin_wafer origin_x origin_y cp_passed ft_passed")).orderBy("cp_lot", "origin_wafer")


def r9_9(m: Model, lot: str) -> DataFrame:
    return m.chipid.where(_is(lot_id=lot)).agg(_n().alias("total_chipids"), F.count(F.when(~F.col("valid"), 1)).alias("invalid_efuse"), F.count(F.when(F.col("origin_fab") == "UNSUPPORTED", 1)).alias("unsupported_fab"))


def r9_10(m: Model, product: str, sub_process: str, lot: str | None = None, test_name_like: str | None = None) -> DataFrame:
    """Final-test values at the wafer coordinates of the dies in the package."""
    rows = _scope(m, product, "FT", sub_process).where(F.col("rec_type").isin("PTR", "MPR") & (F.col("part_txt") != "") & finite("result"))
    if lot is not None:
        rows = rows.where(_is(lot_id=lot))
    rows = _named(rows, test_name_like).select("lot_id", *cols("part_txt test_num test_name units exec_seq result lo_limit hi_limit"), F.col("passed").alias("test_passed"))
    chip = m.chipid_final.where("valid").select("lot_id", *cols("part_txt chip_occurrence_index origin_fab origin_lot origin_wafer origin_x origin_y"))
    return rows.join(chip, ["lot_id", "part_txt"]).orderBy("test_num", *cols("origin_lot origin_wafer origin_x origin_y"))


def r9_10b(values: DataFrame) -> DataFrame:
    return values.groupBy("origin_lot", "origin_wafer", "origin_x", "origin_y").agg(_n().alias("n"), rounded(F.avg("result"), 6).alias("mean_result"), F.min("result").alias("min_result"), F.max("result").alias("max_result")).orderBy("origin_lot", "origin_wafer", "origin_y", "origin_x")


# -- notebook cells


def q_lots(m: Model) -> DataFrame:
    return m.lots.select("lot_id", *cols("product test_category sub_process start_time job_name job_rev")).orderBy(F.desc_nulls_last("start_time"))


def q_lot_yield(m: Model) -> DataFrame:
    """Yield per lot from the testers' own wafer counts."""
    rows = m.lots.select("lot_id", "product", "sub_process").join(m.latest_wafers.select("lot_id", "wafer_id", "part_count", "good_count"), "lot_id")
    per = rows.groupBy("lot_id", "product", "sub_process").agg(F.countDistinct("wafer_id").alias("wafer_count"), F.sum("part_count").alias("total_parts"), F.sum("good_count").alias("good_parts"))
    return per.withColumn("yield_pct", percent("good_parts", "total_parts")).orderBy("lot_id")


def q_wafer(m: Model, lot: str) -> DataFrame:
    return m.latest_wafers.where(_is(lot_id=lot)).select("wafer_id", "part_count", "good_count", percent("good_count", "part_count").alias("yield_pct"), "retest_num").orderBy("wafer_id")


def q_tests(m: Model, lot: str) -> DataFrame:
    return m.test_data_final.where(_is(lot_id=lot)).select("test_num", *cols("test_name rec_type units lo_limit hi_limit")).distinct().orderBy("test_num")


q_fail = r5_3


def q_cpk(m: Model, lot: str, test: str) -> DataFrame:
    mu, sd = F.avg("result"), F.stddev_samp("result")
    lo, hi = F.col("lo_limit"), F.col("hi_limit")
    per = _limited(m, lot).where(_is(test_name=test)).groupBy(*TEST).agg(_n().alias("n"), mu.alias("mu"), sd.alias("sd"), F.min("result").alias("a"), F.max("result").alias("z"), F.median("result").alias("md"))
    mu, sd = F.col("mu"), F.col("sd")
    return per.select(*TEST, "n", rounded(mu, 4).alias("mean"), rounded(sd, 4).alias("sigma"), rounded("a", 4).alias("min_val"), rounded("z", 4).alias("max_val"), rounded("md", 4).alias("median"), rounded(F.try_divide(hi - lo, 6.0 * sd), 3).alias("cp"), rounded(capability(mu, sd, lo, hi), 3).alias("cpk"))


def q_bins(m: Model, lot: str) -> DataFrame:
    return _bins(m.parts_final.where(_is(lot_id=lot))).orderBy(F.desc("die_count"), "hard_bin", "soft_bin")


def q_bin_test(m: Model, lot: str) -> DataFrame:
    on = ["lot_id", "wafer_id", "part_id"]
    die = m.parts_final.where(_is(lot_id=lot) & ~F.col("passed")).select(*on, "hard_bin", "soft_bin")
    test = m.test_data_final.where(_is(lot_id=lot, passed="F")).select(*on, "test_num", "test_name")
    return die.join(test, on).groupBy("hard_bin", "soft_bin", "test_num", "test_name").agg(_n().alias("fail_count")).orderBy(F.desc("fail_count"), "soft_bin", "test_num")


def q_csv(m: Model, lots: Sequence[str]) -> DataFrame:
    """Dies with their measurements: the rows of a lot export."""
    on = ["lot_id", "wafer_id", "part_id"]
    die = m.parts_final.where(F.col("lot_id").isin(*lots)).select(*on, *cols("x_coord y_coord hard_bin soft_bin"), F.col("passed").alias("die_passed"))
    test = m.test_data_final.where(F.col("lot_id").isin(*lots)).select(*on, *cols("test_num test_name result lo_limit hi_limit units"), F.col("passed").alias("test_passed"))
    return die.join(test, on).orderBy("wafer_id", "part_id", "test_num")


EXPORT_KEYS = [*cols("lot_id wafer_id part_id x_coord y_coord hard_bin soft_bin die_passed")]


def lot_pivot(m: Model, lots: Sequence[str], tests: Sequence[str] | None = None) -> DataFrame:
    """One row a die, one column a test: its first non-null result (by measurement order).

    Rows with a null key and tests without any result are left out. The tests' names are
    found with one distinct scan unless given, so that Spark need not plan the pivot twice.
    """
    on = ["lot_id", "wafer_id", "part_id"]
    die = m.parts_final.where(F.col("lot_id").isin(*lots)).select(*on, *cols("x_coord y_coord hard_bin soft_bin"), F.col("passed").alias("die_passed"))
    test = m.test_data_final.where(F.col("lot_id").isin(*lots) & F.col("result").isNotNull()).select(*on, *cols("test_name result test_num exec_seq"))
    if tests is None:
        tests = sorted(r[0] for r in test.select("test_name").distinct().collect() if r[0] is not None)
    rows = die.join(test, on).na.drop(subset=EXPORT_KEYS)
    return rows.groupBy(*EXPORT_KEYS).pivot("test_name", list(tests)).agg(F.min_by("result", F.struct("test_num", "exec_seq", "result"))).orderBy("lot_id", "wafer_id", "part_id")


assert NO_COORD == -32768
