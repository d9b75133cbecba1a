"""Retest semantics as windows: run numbers, occurrence order, and which run is current.

A measurement's key is the die's identity within its lot with test and pin. The newest
run that holds a key has flag 0, each older run one more: a dense rank, which needs no
rewriting of older rows one run at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silicore.functions.expr import cols, package_text

STORE_KEYS = ("product", "test_category", "sub_process")
#: Bytes of Parquet, some 200,000 to 700,000 measurements, for which ``spread`` makes a task.
TASK_BYTES = 4 << 20
#: Spark's figure for sources of unknown size is 8 EB; a sum from here on holds one.
UNKNOWN_BYTES = 1 << 60


def _key(df: DataFrame) -> list:
    return [*[F.col(c) for c in STORE_KEYS if c in df.columns], F.col("lot_id"), F.col("wafer_id"), F.col("x_coord"), F.col("y_coord"), package_text(), F.col("test_num"), F.col("pin_num")]


def with_exec_seq(df: DataFrame, *order: str) -> DataFrame:
    """exec_seq: the place, from 0, of a measurement among those of its key in its run."""
    w = Window.partitionBy(*_key(df), "retest_num").orderBy(*order)
    return df.withColumn("exec_seq", (F.row_number().over(w) - 1).cast("bigint"))


def with_retest_flag(df: DataFrame) -> DataFrame:
    """retest_flag: 0 for the newest run that holds the key, then 1, 2, ..."""
    w = Window.partitionBy(*_key(df)).orderBy(F.desc("retest_num"))
    return df.withColumn("retest_flag", (F.dense_rank().over(w) - 1).cast("bigint"))


def demote(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """``current`` after the run ``fresh`` (flag 0) came in: rows with a key that it holds move
    up by one; rows without a flag stay as they are. A null pin matches a null pin."""
    key = [*cols("lot_id wafer_id x_coord y_coord __text test_num")]
    new = fresh.withColumn("__text", package_text()).select(*key, F.col("pin_num").alias("__pin")).distinct().withColumn("__hit", F.lit(1))
    old = current.withColumn("__text", package_text())
    out = old.join(new.select(*[F.col(k).alias(f"n_{k}") for k in key], "__pin", "__hit"), [old[k].eqNullSafe(F.col(f"n_{k}")) for k in key] + [F.col("pin_num").eqNullSafe(F.col("__pin"))], "left")
    return out.withColumn("retest_flag", F.when(F.col("__hit").isNotNull(), F.col("retest_flag") + 1).otherwise(F.col("retest_flag"))).select(*current.columns)


def spread(df: DataFrame, *keys) -> DataFrame:
    """``df`` shuffled by ``keys`` into at least as many tasks as its files hold pieces of ``TASK_BYTES``,
    so that a task's rows don't grow with the input; Spark's own choice (tasks of 64 MB shuffled, which
    can be several million rows) where the size of a source is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= UNKNOWN_BYTES:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), *keys)


def verify_flags(df: DataFrame, lot: str | None = None) -> DataFrame:
    """(lot_id, rows, null_flags, orphaned_keys, inconsistent_runs, dup_current), a row a lot.

    Two grouped passes over all lots, by key and run, then by key, in one shuffle by key.
    """
    if lot is not None:
        df = df.where(F.col("lot_id") == lot)
    key = [*cols("lot_id wafer_id x_coord y_coord __text test_num pin_num")]
    rows = spread(df.withColumn("__text", package_text()).select(*key, "retest_num", "retest_flag"), *key)
    runs = rows.groupBy(*key, "retest_num").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("retest_flag").isNull(), 1)).alias("nulls"), F.min("retest_flag").alias("lo"), F.max("retest_flag").alias("hi"), F.max((F.col("retest_flag") == 0).cast("int")).alias("now")
    )
    keys = runs.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("lo").alias("lo"), F.count(F.when(F.col("lo") != F.col("hi"), 1)).alias("mixed"), F.count(F.when(F.col("now") == 1, 1)).alias("current"))
    return keys.groupBy("lot_id").agg(
        F.sum("n").alias("rows"), F.sum("nulls").alias("null_flags"), F.count(F.when(F.col("lo") != 0, 1)).alias("orphaned_keys"), F.sum("mixed").alias("inconsistent_runs"), F.count(F.when(F.col("current") > 1, 1)).alias("dup_current")
    )
