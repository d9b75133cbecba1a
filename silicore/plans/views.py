"""The published logical tables as lazy DataFrames.

``Model`` holds the five stored tables and the gross-die table, and derives what
reports read: the newest run of every die, package and chip, the current
measurements, and the one definition of yield.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silicore.functions.expr import cols, package_text, percent
from silicore.sources.schemas import GROSS_DIE


def newest(df: DataFrame, *keys, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key with the highest retest_num; ``ties`` decide between equals.

    Spark prunes each partition to one row a key before the shuffle (WindowGroupLimit).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("retest_num"), *[F.desc_nulls_last(t) for t in ties])
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def gross_die_table(spark: SparkSession, dies: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """(product, gross_die, gd_fail_bin) from configuration; empty, but there, without any."""
    return spark.createDataFrame([(p, g, b) for p, (g, b) in (dies or {}).items()], GROSS_DIE)


@dataclass(frozen=True)
class Model:
    lots: DataFrame | None = None
    wafers: DataFrame | None = None
    parts: DataFrame | None = None
    test_data: DataFrame | None = None
    chipid: DataFrame | None = None
    gross_die: DataFrame | None = None
    #: Columns of ``parts`` and ``chipid`` that make ties of one run deterministic.
    ties: tuple[str, ...] = ("part_id",)

    @cached_property
    def parts_final(self) -> DataFrame:
        return newest(self.parts, *cols("lot_id wafer_id x_coord y_coord"), package_text(), ties=self.ties)

    @cached_property
    def test_data_final(self) -> DataFrame:
        """Current measurements: a pushable predicate, no window. Null flags are not current."""
        return self.test_data.where("retest_flag = 0")

    @cached_property
    def chipid_final(self) -> DataFrame:
        return newest(self.chipid, "lot_id", "efuse_raw", ties=(*self.ties, "chip_occurrence_index"))

    @cached_property
    def wafer_yield_final(self) -> DataFrame:
        """Per (lot, wafer): probed dies, good dies, and the total that yields are over.

        A wafer of a product with a gross-die count has at least that many; the dies
        that were never probed count as failed.
        """
        probed = self.parts_final.groupBy("lot_id", "wafer_id").agg(F.count(F.lit(1)).alias("probed"), F.count(F.when(F.col("passed"), 1)).alias("good"))
        if self.lots is None:
            df = probed.withColumn("product", F.lit(None).cast("string"))
        else:
            df = probed.join(self.lots.groupBy("lot_id").agg(F.max("product").alias("product")), "lot_id", "left")
        # One row a configured product: its size is the configuration's, not the data's.
        gross = self.gross_die if self.gross_die is not None else gross_die_table(probed.sparkSession)
        df = df.join(F.broadcast(gross), "product", "left")
        planned = (F.col("wafer_id") != "") & F.col("gross_die").isNotNull()
        total = F.when(planned, F.greatest("probed", "gross_die")).otherwise(F.col("probed"))
        df = df.withColumn("total", total)
        return df.select("lot_id", *cols("wafer_id probed good total"), (F.col("total") - F.col("probed")).alias("unprobed"), "gd_fail_bin", percent("good", "total").alias("yield_pct"))

    def only_lots(self, lots: DataFrame) -> Model:
        """The model of the lots in ``lots`` (lot_id): measurements and dies of others are
        left out before any window; on a store the join prunes folders."""
        keep = lambda t: t if t is None else t.join(lots.select("lot_id").distinct(), "lot_id", "left_semi")
        return replace(self, wafers=keep(self.wafers), parts=keep(self.parts), test_data=keep(self.test_data), chipid=keep(self.chipid))

    @cached_property
    def latest_lots(self) -> DataFrame:
        """One row per (product, category, lot), the last started."""
        w = Window.partitionBy("product", "test_category", "lot_id").orderBy(F.desc_nulls_last("start_time"), F.desc_nulls_last("job_name"), F.desc_nulls_last("job_rev"))
        return self.lots.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")

    @cached_property
    def latest_wafers(self) -> DataFrame:
        return newest(self.wafers, "lot_id", "wafer_id")

    NAMES = tuple(cols("lots wafers parts test_data chipid"))

    def register(self, spark: SparkSession | None = None) -> list[str]:
        """Create a temp view for every table that there is and for what derives from it; their names."""
        there = [t for t in self.NAMES if getattr(self, t) is not None]
        derived = [n for n, t in (("parts_final", "parts"), ("test_data_final", "test_data"), ("chipid_final", "chipid"), ("wafer_yield_final", "parts")) if t in there]
        for n in [*there, *derived]:
            getattr(self, n).createOrReplaceTempView(n)
        if self.gross_die is not None:
            self.gross_die.createOrReplaceTempView("gross_die")
        return [*there, *derived]
