"""Shared plumbing of the training-data operators: the shared folder, written
intermediates, and broadcasts that are only taken behind a size check."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a keyed side table is broadcast; beyond it the same join is
#: left to a shuffle. A few million narrow rows are tens of MB per executor.
BROADCAST_ROWS = 1_000_000
#: The paths that ``stored`` has written, where someone keeps account of them.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, named by ``spark.checkpoint.dir``.

    Only when a session in one process (tests) names none a folder of our own is set,
    once per session; on a cluster, where no executor would see it, that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="silicore-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, tag))


def stored(df: DataFrame, tag: str) -> str:
    """The path in the shared folder where ``df`` now lies as Parquet."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if (written := WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that ``stored`` has written and that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(df: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``own`` under generated names, so that no name of the
    caller's meets one of an operator's; and the function that gives the names back."""
    names = df.columns
    inner = [n if n in own else f"__in{i}" for i, n in enumerate(names)]
    return df.toDF(*inner), lambda out: out.select(*[F.col(i).alias(n) for i, n in zip(inner, names)])


def release() -> None:
    """Hand freed memory back, so that a reused Python worker does not keep a task's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
