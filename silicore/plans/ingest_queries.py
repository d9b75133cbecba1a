"""Registered queries of the ingest side: logs are written from ``nation``, taken in, and read back.

Every nation is a lot ``N<key>`` of one wafer. The first batch probes 2 + regionkey dies; the
second probes the first 1 + regionkey of them again, for all but region 0, and die 0 fails in it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silicore.operators.retest import verify_flags
from silicore.sources.logwriter import wafer_test
from silicore.sources.store import Store
from silicore.sources.testlog import read_logs
from silicore.streaming.ingest import Ingest


def _folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{named or tempfile.mkdtemp(prefix='silicore-')}/ingest-{uuid.uuid4().hex}"


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data))
    out.close()


def _lots(spark: SparkSession, sf_dir: str) -> list:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()  # 25 rows at every scale


def _ingested(spark: SparkSession, sf_dir: str) -> Store:
    base = _folder(spark)
    store = Store(spark, f"{base}/store")
    for k in (0, 1):
        for key, region in _lots(spark, sf_dir):
            if k == 0 or region > 0:
                _write(spark, f"{base}/logs/N{key}_x#{k}.log", wafer_test(f"N{key}", parts=int(2 + region - k), fail=(0,) if k else (), start=1_700_000_000 + k * 100_000))
        Ingest(store, "PN").directory(f"{base}/logs")
    return store


def ingest_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lot_id, retest_num, retest_flag, rows, fails) of the measurements after both batches."""
    m = _ingested(spark, sf_dir).model()
    return m.test_data.groupBy("lot_id", "retest_num", "retest_flag").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("passed") == "F", 1)).alias("fails"))


def ingest_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _ingested(spark, sf_dir).model()
    return m.wafer_yield_final.select("lot_id", "wafer_id", "total", "good", "yield_pct")


def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, n) of the records of the first batch's logs, as the parser gives them."""
    base = _folder(spark)
    for key, region in _lots(spark, sf_dir):
        _write(spark, f"{base}/N{key}_x#0.log", wafer_test(f"N{key}", parts=int(2 + region)))
    return read_logs(spark, base).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def verify_broken_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``verify_flags`` over measurements some of whose flags are spoilt: the flag of retest 0 of
    test 1001 is lost on lots of region 1, is 0 on lots of region 2, and starts at 1 on lots of region 3."""
    m = _ingested(spark, sf_dir).model()
    region = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("lot_id"), "n_regionkey")
    rows = m.test_data.join(F.broadcast(region), "lot_id")
    spoilt = F.when((F.col("n_regionkey") == 1) & (F.col("retest_num") == 0), None).when((F.col("n_regionkey") == 2) & (F.col("retest_num") == 0), 0).when(F.col("n_regionkey") == 3, F.col("retest_flag") + 1).otherwise(F.col("retest_flag"))
    return verify_flags(rows.withColumn("retest_flag", spoilt.cast("bigint")).drop("n_regionkey"))


QUERIES = {"ingest_two_batches": ingest_two_batches, "ingest_yield": ingest_yield, "parse_records": parse_records, "verify_broken_flags": verify_broken_flags}

_DIES = """d AS (SELECT 'N' || n_nationkey AS lot_id, n_regionkey AS r, k, i, k = 1 AND i = 0 AS fail
  FROM nation, (VALUES (0), (1)) b(k), (SELECT unnest(range(8)) AS i) WHERE i < 2 + n_regionkey - k AND (k = 0 OR n_regionkey > 0)),
f AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY lot_id, i ORDER BY k DESC) - 1 AS BIGINT) AS flag FROM d)"""
_SPOILT = f"""{_DIES},
s AS (SELECT lot_id, i, k, CASE WHEN r = 1 AND k = 0 THEN NULL WHEN r = 2 AND k = 0 THEN 0 WHEN r = 3 THEN flag + 1 ELSE flag END AS flag FROM f),
p AS (SELECT lot_id, i, count(*) AS n, count(*) FILTER (WHERE flag IS NULL) AS nulls, min(flag) AS lo, count(*) FILTER (WHERE flag = 0) AS cur FROM s GROUP BY lot_id, i)"""
ORACLES = {
    "ingest_two_batches": f"WITH {_DIES} SELECT lot_id, CAST(k AS BIGINT) AS retest_num, flag AS retest_flag, count(*) AS rows, count(*) FILTER (WHERE fail) AS fails FROM f GROUP BY lot_id, k, flag",
    "ingest_yield": f"WITH {_DIES} SELECT lot_id, 'W1' AS wafer_id, count(*) AS total, count(*) FILTER (WHERE NOT fail) AS good, round(100.0 * count(*) FILTER (WHERE NOT fail) / count(*), 2) AS yield_pct FROM f WHERE flag = 0 GROUP BY lot_id",
    "parse_records": f"WITH {_DIES} SELECT 'lot' AS kind, count(DISTINCT lot_id) AS n FROM d UNION ALL SELECT 'wafer', count(DISTINCT lot_id) FROM d UNION ALL SELECT 'part', count(*) FROM d WHERE k = 0 UNION ALL SELECT 'test', count(*) FROM d WHERE k = 0",
    "verify_broken_flags": f"WITH {_SPOILT} SELECT lot_id, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(nulls) AS BIGINT) AS null_flags, count(*) FILTER (WHERE lo <> 0) AS orphaned_keys, 0::BIGINT AS inconsistent_runs, count(*) FILTER (WHERE cur > 1) AS dup_current FROM p GROUP BY lot_id",
}
