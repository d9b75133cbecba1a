"""Exact dedup: an extendible-hash index on shared files.

The key of a text is its 64-bit xxHash. A directory over the key's leading bits
doubles where a bucket's bytes exceed the capacity (see ``extendible``), so equal
shares of the bytes, not of the hash space, go to the owners: each owner task takes
a contiguous range of directory slots. An owner sorts its rows by key, chains
the rows of one key and compares their bytes, and appends to its bucket files which
row every copy repeats. The index lies in the shared folder, so results survive the
loss of any executor.

Defined results
  * of byte-identical texts the row with the smallest doc_id is kept (a null
    doc_id sorts last; ties between equal ids keep exactly one row);
  * a null text equals no other text: such rows are all kept; empty texts equal one another;
  * texts that differ in any byte (case, space) are different;
  * an empty table: an empty result;
  * extra columns, whatever their names, do not count in the comparison; they are
    ignored by ``find_copies`` and carried through by ``drop_copies``.

The text is shuffled once. Bytes are compared within a chain only, since the sort
looks at the text where keys tie. A key whose rows outweigh an owner (one text, very
often) cannot be split by bits: ``drop_copies`` first deals its rows out to as many tasks as
it has owners' shares, each of which keeps one row a text, so that its owner gets few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shielded, small, table
from .extendible import directory, locate

#: Bytes of text that a bucket may hold before it splits, and that an owner takes.
CAPACITY = 8 << 20
OWNER_BYTES = 32 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__x_hash": F.xxhash64("text"), "__x_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")}).withColumn("__x_key", F.expr("shiftrightunsigned(__x_hash, 4)"))


def _owned(docs: DataFrame, capacity: int, owner_bytes: int, thin: bool = False) -> DataFrame:
    """``docs`` with a text, each row at the owner of its bucket: __x_owner, __x_bucket, __x_hash.
    ``thin``: of a key that outweighs an owner, some copies may be left out."""
    light = materialize(_keyed(docs.select("text").where("text IS NOT NULL")).select("__x_key", "__x_bytes"), "op6-keys")
    levels = directory(light, capacity)
    buckets = locate(light, levels).groupBy("__x_depth", "__x_bucket").agg(F.sum("__x_bytes").alias("__x_sum"))
    # Owners are ranges of the key space: buckets in key order, cut by running bytes.
    start = F.expr("shiftleft(__x_bucket, 60 - __x_depth)")
    w = Window.partitionBy("__x_zone").orderBy("__x_start")
    buckets = materialize(buckets.withColumn("__x_start", start).withColumn("__x_zone", F.expr("shiftright(__x_start, 54)")), "op6-buckets")
    zones = buckets.groupBy("__x_zone").agg(F.sum("__x_sum").alias("__x_zsum"))
    before = zones.withColumn("__x_before", F.coalesce(F.sum("__x_zsum").over(Window.orderBy("__x_zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.col("__x_before") + F.sum("__x_sum").over(w) - 1
    owners = buckets.join(F.broadcast(before), "__x_zone").withColumn("__x_owner", F.greatest(F.lit(0), F.floor(run / owner_bytes)).cast("int")).select("__x_depth", "__x_bucket", "__x_owner", F.ceil(F.col("__x_sum") / owner_bytes).alias("__x_shares"))
    owners = materialize(owners, "op6-owners")
    n = (owners.agg(F.max("__x_owner")).first()[0] or 0) + 1
    rows = locate(_keyed(docs.where("text IS NOT NULL")), levels).join(small(owners), ["__x_depth", "__x_bucket"])
    if thin and not owners.where("__x_shares > 1").isEmpty():
        w = Window.partitionBy("__x_hash", "text", "__x_share").orderBy(F.col("doc_id").asc_nulls_last())
        many = rows.where("__x_shares > 1").withColumn("__x_share", F.pmod(F.monotonically_increasing_id(), F.col("__x_shares")))
        many = many.withColumn("__x_place", F.row_number().over(w)).where("__x_place = 1").drop("__x_share", "__x_place")
        rows = rows.where("__x_shares <= 1").unionByName(many)
    return rows.drop("__x_depth", "__x_key", "__x_bytes", "__x_shares").repartitionById(n, F.col("__x_owner"))


def _chain(rows: DataFrame, order: list) -> tuple:
    w = Window.partitionBy("__x_owner", "__x_hash", "text").orderBy(*order)
    return F.row_number().over(w), w


def find_copies(docs: DataFrame, capacity: int = CAPACITY, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """(doc_id, kept_doc_id, is_copy), one row a document."""
    only = docs.select("doc_id", "text")
    rows = _owned(only, capacity, owner_bytes)
    place, w = _chain(rows, [F.col("doc_id").asc_nulls_last()])
    index = rows.select("__x_owner", "__x_bucket", "__x_hash", "doc_id", F.first("doc_id").over(w).alias("kept_doc_id"), (place > 1).alias("is_copy"))
    index = materialize(index, "op6-index")
    alone = only.where("text IS NULL").select("doc_id", F.col("doc_id").alias("kept_doc_id"), F.lit(False).alias("is_copy"))
    return index.select("doc_id", "kept_doc_id", "is_copy").unionByName(alone)


def drop_copies(docs: DataFrame, capacity: int = CAPACITY, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """The kept rows of ``docs``, all columns unchanged."""
    inner, given = shielded(docs, "doc_id", "text")
    rows = _owned(inner, capacity, owner_bytes, thin=True)
    place, _ = _chain(rows, [F.col("doc_id").asc_nulls_last()])
    return given(rows.withColumn("__x_place", place).where("__x_place = 1")).unionByName(docs.where("text IS NULL"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


def op6_exact_dedup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with buckets and owners so small that small tables double the directory too."""
    return find_copies(table(spark, sf_dir, "documents"), capacity=32 << 10, owner_bytes=128 << 10)


ORACLE = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS kept_doc_id,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 AS is_copy
FROM documents"""
