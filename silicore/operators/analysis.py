"""The analysis functions: lazy DataFrames over a ``Model``.

``fig``-like functions return (spec, DataFrame): a plain dict that describes traces and
lines, and the data behind it, so that any plotting library can draw them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silicore.functions.expr import cols, capability, fail_count, good_count, percent, ratio, rounded
from silicore.plans.views import Model

TOP_FAIL_TESTS = 20
ZONES = cols("center mid edge")


def _numeric(m: Model) -> DataFrame:
    return m.test_data_final.where(F.col("result").isNotNull() & F.col("rec_type").isin("PTR", "MPR"))


# -- one lot


def lot_summary(m: Model, lot_id: str | None = None) -> DataFrame:
    lots, wafers = m.lots, m.wafer_yield_final
    if lot_id is not None:
        lots, wafers = lots.where(F.col("lot_id") == lot_id), wafers.where(F.col("lot_id") == lot_id)
    per_lot = wafers.groupBy("lot_id").agg(F.count(F.when(F.col("wafer_id") != "", 1)).alias("wafer_count"), F.sum("total").alias("total_parts"), F.sum("good").alias("good_parts"))
    head = [*cols("lot_id product test_category sub_process part_type job_name job_rev")]
    out = lots.select(*head).distinct().join(per_lot, "lot_id", "left").withColumn("yield_pct", percent("good_parts", "total_parts"))
    return out.orderBy("product", "test_category", "sub_process", "lot_id")


def wafer_yield(m: Model, lot_id: str) -> DataFrame:
    return m.wafer_yield_final.where(F.col("lot_id") == lot_id).select("wafer_id", "total", "good", "yield_pct").orderBy("wafer_id")


def test_fail_rate(m: Model, lot_id: str, top_n: int = 10) -> DataFrame:
    per = m.test_data_final.where(F.col("lot_id") == lot_id).groupBy("test_num", "test_name").agg(F.count(F.lit(1)).alias("total"), fail_count().alias("fails"))
    return per.where("fails > 0").withColumn("fail_rate", percent("fails", "total")).orderBy(F.desc("fail_rate"), "test_num", "test_name").limit(top_n)


def _binned(m: Model, lots: Sequence[str]) -> DataFrame:
    """(lot_id, soft_bin, count): probed dies, and the unprobed under their product's fail bin."""
    probed = m.parts_final.where(F.col("lot_id").isin(*lots)).groupBy("lot_id", "soft_bin").agg(F.count(F.lit(1)).alias("count"))
    lost = m.wafer_yield_final.where(F.col("lot_id").isin(*lots) & F.col("gd_fail_bin").isNotNull() & (F.col("unprobed") > 0))
    lost = lost.groupBy("lot_id", F.col("gd_fail_bin").alias("soft_bin")).agg(F.sum("unprobed").alias("count"))
    return probed.unionByName(lost).groupBy("lot_id", "soft_bin").agg(F.sum("count").alias("count"))


def bin_summary(m: Model, lot_id: str) -> DataFrame:
    bins = _binned(m, [lot_id]).drop("lot_id")
    return bins.withColumn("pct", percent("count", F.sum("count").over(Window.partitionBy()))).orderBy("soft_bin")


# -- lots side by side


def yield_by_lot(m: Model, lot_ids: Sequence[str]) -> DataFrame:
    return m.wafer_yield_final.where(F.col("lot_id").isin(*lot_ids)).select("lot_id", *cols("wafer_id total good yield_pct")).orderBy("lot_id", "wafer_id")


def bin_pareto_by_lot(m: Model, lot_ids: Sequence[str]) -> DataFrame:
    bins = _binned(m, lot_ids)
    return bins.withColumn("pct", percent("count", F.sum("count").over(Window.partitionBy("lot_id")))).orderBy("lot_id", F.desc("count"), "soft_bin")


def top_fail_tests(m: Model, lot_ids: Sequence[str], top_n: int = TOP_FAIL_TESTS) -> DataFrame:
    """test_num of the tests that fail most in any of the lots: one plan for all lots."""
    per = m.test_data_final.where(F.col("lot_id").isin(*lot_ids)).groupBy("lot_id", "test_num").agg(F.count(F.lit(1)).alias("n"), fail_count().alias("f")).where("f > 0")
    w = Window.partitionBy("lot_id").orderBy(F.desc(percent("f", "n")), "test_num")
    return per.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_n).select("test_num").distinct()


def test_stats_by_lot(m: Model, lot_ids: Sequence[str], test_nums: Sequence[int] | None = None) -> DataFrame:
    rows = _numeric(m).where(F.col("lot_id").isin(*lot_ids) & F.col("lo_limit").isNotNull() & F.col("hi_limit").isNotNull())
    if test_nums is None:
        rows = rows.join(top_fail_tests(m, lot_ids), "test_num", "left_semi")
    else:
        rows = rows.where(F.col("test_num").isin(*test_nums))
    mean, std = F.avg("result"), F.stddev_pop("result")
    lo, hi = F.min("lo_limit"), F.max("hi_limit")
    out = rows.groupBy("lot_id", "test_num").agg(F.count(F.lit(1)).alias("n"), rounded(mean, 6).alias("mean"), rounded(std, 6).alias("std"), rounded(capability(mean, std, lo, hi), 3).alias("cpk"), lo.alias("lo_limit"), hi.alias("hi_limit"))
    return out.orderBy("lot_id", "test_num")


def histogram(m: Model, lot_ids: Sequence[str], test_num: int, bins: int = 40) -> DataFrame:
    """(lot_id, bin, bin_lo, bin_hi, n): per-lot counts over the common range, none collected."""
    rows = m.test_data_final.where(F.col("lot_id").isin(*lot_ids) & (F.col("test_num") == test_num) & F.col("result").isNotNull()).select("lot_id", "result")
    span = F.broadcast(rows.agg(F.min("result").alias("lo"), F.max("result").alias("hi")))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(ratio(F.col("result") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)).cast("int")
    step = (F.col("hi") - F.col("lo")) / bins
    out = rows.crossJoin(span).withColumn("bin", at).groupBy("lot_id", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return out.select("lot_id", "bin", rounded(F.col("lo") + step * F.col("bin"), 6).alias("bin_lo"), rounded(F.col("lo") + step * (F.col("bin") + 1), 6).alias("bin_hi"), "n").orderBy("lot_id", "bin")


def test_distribution(m: Model, lot_ids: Sequence[str], test_num: int, bins: int = 40) -> tuple[dict, DataFrame]:
    data = histogram(m, lot_ids, test_num, bins)
    about = m.test_data_final.where(F.col("lot_id").isin(*lot_ids) & (F.col("test_num") == test_num)).agg(F.max("test_name"), F.max("units"), F.min("lo_limit"), F.max("hi_limit")).first()
    name, units, lo, hi = about
    lines = [{"x": v, "label": label, "dash": True} for label, v in (("LSL", lo), ("USL", hi)) if v is not None]
    return {"kind": "histogram", "overlay": True, "bins": bins, "title": f"{test_num} {name or ''} [{units or ''}], lots compared", "lines": lines}, data


# -- over time


def _last(df: DataFrame, last_n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("start_t"), F.desc("lot_id")).limit(last_n).orderBy(F.asc_nulls_last("start_t"), "lot_id")


def _started(m: Model, product: str, test_category: str) -> DataFrame:
    return m.latest_lots.where((F.col("product") == product) & (F.col("test_category") == test_category)).select("lot_id", F.col("start_time").alias("start_t"))


def lot_trend(m: Model, product: str, test_category: str, last_n: int = 30) -> DataFrame:
    started = _started(m, product, test_category)
    per = m.only_lots(started).parts_final.groupBy("lot_id").agg(F.count(F.lit(1)).alias("total"), good_count().alias("good"))
    out = per.join(started, "lot_id").select("lot_id", "start_t", "total", "good", percent("good", "total").alias("yield_pct"))
    return _last(out, last_n)


def test_trend(m: Model, product: str, test_category: str, test_num: int, last_n: int = 30) -> DataFrame:
    mean, std = F.avg("result"), F.stddev_pop("result")
    started = _started(m, product, test_category)
    per = _numeric(m.only_lots(started)).where(F.col("test_num") == test_num).groupBy("lot_id").agg(F.count(F.lit(1)).alias("n"), rounded(mean, 6).alias("mean"), rounded(std, 6).alias("std"), rounded(capability(mean, std, F.min("lo_limit"), F.max("hi_limit")), 3).alias("cpk"))
    return _last(per.join(started, "lot_id").select("lot_id", *cols("start_t n mean std cpk")), last_n)


def control_limits(trend: DataFrame, y: str) -> DataFrame:
    """(mean, upper, lower): mean and three population sigmas; null with fewer than two points."""
    mu, sd = F.avg(y), F.stddev_pop(y)
    enough = F.count(y) >= 2
    return trend.agg(*[F.when(enough, rounded(c, 6)).alias(n) for c, n in ((mu, "mean"), (mu + 3 * sd, "upper"), (mu - 3 * sd, "lower"))])


def trend_figure(trend: DataFrame, y: str, limits: bool = True) -> tuple[dict, DataFrame]:
    lines = []
    if limits:
        row = control_limits(trend, y).first()
        lines = [{"y": row[k], "label": label, "dash": k != "mean"} for k, label in (("mean", "mean"), ("upper", "+3σ"), ("lower", "-3σ")) if row[k] is not None]
    return {"kind": "lines+markers", "title": f"Trend: {y}", "x": "lot_id", "y": y, "lines": lines}, trend


# -- wafer test against final test


def cp_ft_yield(m: Model, product: str, lot_ids: Sequence[str] | None = None) -> DataFrame:
    rows = m.parts_final.where(F.col("product") == product)
    if lot_ids is not None:
        rows = rows.where(F.col("lot_id").isin(*lot_ids))

    def side(cat: str) -> DataFrame:
        n = cat.lower()
        per = rows.where(F.col("test_category") == cat).groupBy("lot_id").agg(F.count(F.lit(1)).alias(f"{n}_total"), good_count().alias("g"))
        return per.withColumn(f"{n}_yield_pct", percent("g", f"{n}_total")).drop("g")

    return side("CP").join(side("FT"), "lot_id", "full").orderBy("lot_id")


def die_cp_ft_join(m: Model, product: str, lot_id: str) -> DataFrame:
    """Valid chips of a final-test lot with the die that they were at wafer test."""
    chip = m.chipid_final.where((F.col("lot_id") == lot_id) & F.col("valid"))
    chip = chip.select(F.col("part_id").alias("ft_part_id"), F.col("part_txt").alias("ft_part_txt"), "origin_fab", F.col("origin_lot").alias("cp_lot_id"), F.col("origin_wafer").alias("cp_wafer"), F.col("origin_x").alias("cp_x"), F.col("origin_y").alias("cp_y"))
    die = m.parts_final.where((F.col("product") == product) & (F.col("test_category") == "CP"))
    die = die.select(F.col("lot_id").alias("cp_lot_id"), F.col("x_coord").alias("cp_x"), F.col("y_coord").alias("cp_y"), F.col("wafer_id").alias("cp_wafer_id_str"), F.col("soft_bin").alias("cp_soft_bin"), F.col("hard_bin").alias("cp_hard_bin"), F.col("passed").alias("cp_passed"))
    number = F.expr("try_cast(cp_wafer_id_str AS BIGINT)")
    out = chip.join(die, ["cp_lot_id", "cp_x", "cp_y"]).where(number.isNull() | (number == F.col("cp_wafer")))
    return out.select("ft_part_id", *cols("ft_part_txt origin_fab cp_lot_id cp_wafer cp_x cp_y cp_wafer_id_str cp_soft_bin cp_hard_bin cp_passed")).orderBy("ft_part_txt", "cp_x", "cp_y")


def test_correlation(m: Model, lot_id: str, test_nums: Sequence[int]) -> DataFrame:
    """(test_a, test_b, n, r): Pearson over the parts that have both, means of repeats."""
    nums = sorted(set(test_nums))
    wide = _numeric(m).where((F.col("lot_id") == lot_id) & F.col("test_num").isin(*nums)).groupBy("part_id").pivot("test_num", nums).agg(F.avg("result"))
    aggs = []
    for a in nums:
        for b in nums:
            x = F.when(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(), F.col(f"`{a}`"))
            y = F.when(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(), F.col(f"`{b}`"))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            aggs.append(F.struct(F.lit(a).cast("bigint").alias("test_a"), F.lit(b).cast("bigint").alias("test_b"), F.count(x).alias("n"), rounded(r, 6).alias("r")))
    return wide.agg(F.array(*aggs).alias("all")).select(F.inline("all")).orderBy("test_a", "test_b")


def correlation_matrix(long: DataFrame) -> DataFrame:
    return long.groupBy("test_a").pivot("test_b").agg(F.first("r")).orderBy("test_a")


# -- on the wafer


def _radius(m: Model, lot_id: str) -> DataFrame:
    """Dies of a lot with rnorm: distance from the middle of the lot's extent, 1 the farthest."""
    die = m.parts_final.where(F.col("lot_id") == lot_id)
    ext = die.agg(((F.min("x_coord") + F.max("x_coord")) / 2.0).alias("cx"), ((F.min("y_coord") + F.max("y_coord")) / 2.0).alias("cy"))
    dx, dy = F.col("x_coord") - F.col("cx"), F.col("y_coord") - F.col("cy")
    rad = die.crossJoin(F.broadcast(ext)).withColumn("rad", F.sqrt(dx * dx + dy * dy))
    top = rad.agg(F.max("rad").alias("rmax"))
    return rad.crossJoin(F.broadcast(top)).withColumn("rnorm", F.when(F.col("rmax") == 0, 0.0).otherwise(F.col("rad") / F.col("rmax")))


def _ring(n: int):
    return F.least(F.lit(n - 1), F.floor(F.col("rnorm") * n)).cast("int")


def zone_yield(m: Model, lot_id: str, n_zones: int = 3) -> DataFrame:
    per = _radius(m, lot_id).groupBy(_ring(n_zones).alias("zone_idx")).agg(F.count(F.lit(1)).alias("total"), good_count().alias("good"))
    name = F.concat(F.lit("zone_"), F.col("zone_idx").cast("string"))
    if n_zones == 3:
        name = F.element_at(F.array(*[F.lit(z) for z in ZONES]), F.col("zone_idx") + 1)
    return per.select(name.alias("zone"), "zone_idx", "total", "good", percent("good", "total").alias("yield_pct")).orderBy("zone_idx")


def radial_profile(m: Model, lot_id: str, test_num: int, by: str = "part_id") -> DataFrame:
    """Mean and sigma of a test over ten rings. ``by``="die" joins on the die's place instead
    of part_id, which restarts in every file and so may meet another run's die."""
    keys = ["part_id"] if by == "part_id" else ["wafer_id", "x_coord", "y_coord"]
    values = _numeric(m).where((F.col("lot_id") == lot_id) & (F.col("test_num") == test_num)).select(*keys, "result")
    rows = values.join(_radius(m, lot_id).select(*keys, "rnorm"), keys)
    return rows.groupBy(_ring(10).alias("radius_bin")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("result"), 6).alias("mean"), rounded(F.stddev_pop("result"), 6).alias("std")).orderBy("radius_bin")


def wafermap(m: Model, lot_id: str, wafer_id: str, test_num: int) -> DataFrame:
    rows = m.test_data_final.where((F.col("lot_id") == lot_id) & (F.col("wafer_id") == wafer_id) & (F.col("test_num") == test_num) & F.col("result").isNotNull())
    return rows.groupBy("x_coord", "y_coord").agg(rounded(F.avg("result"), 6).alias("result")).orderBy("y_coord", "x_coord")


def wafermap_figure(m: Model, lot_id: str, wafer_id: str, test_num: int) -> tuple[dict, DataFrame]:
    return {"kind": "map", "title": f"Wafer {wafer_id} test #{test_num}", "x": "x_coord", "y": "y_coord", "color": "result", "y_reversed": True, "square": True}, wafermap(m, lot_id, wafer_id, test_num)


def session_lots(m: Model, product: str | None = None, test_category: str | None = None) -> DataFrame:
    """One row a lot, newest first; filters are left out where not given."""
    out = m.latest_lots
    for c, v in (("product", product), ("test_category", test_category)):
        if v is not None:
            out = out.where(F.col(c) == v)
    return out.orderBy(F.desc_nulls_last("start_time"), "lot_id")
