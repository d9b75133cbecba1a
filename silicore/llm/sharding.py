"""Sharding by extendible hashing.

A document's key is the first 60 bits of an MD5 over its id and text. The directory
is indexed by key-prefix bits, and only a bucket over the byte limit splits on
another bit (see ``extendible``). Identical rows share a key and cannot be split by
bits: such a bucket is cut by position into pages, each within the limit.

Defined results
  * null or empty text weighs 0 bytes; a null doc_id is a key like any other;
  * a document that alone exceeds the limit has a page to itself, ``oversize`` true;
  * repeated rows: each is placed; pages separate them only where they must;
  * an empty table: no shard;
  * extra columns: ``shard`` ignores them, ``place`` and ``save`` carry them through.

``shard``, the registered query, gives the assignment only: (id, key, bytes) is shuffled,
never the text. ``save`` writes the shards and moves the text once. The directory grows with
data / limit and is broadcast behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shielded, table
from .extendible import directory, locate

LIMIT = 8 << 20


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, depth, shard, page, oversize), one row a document; ``shard``
    is the key prefix of ``depth`` bits."""
    light = materialize(docs.select("doc_id", *_keyed()), "op9-keys")
    placed = materialize(locate(light, directory(light, limit)), "op9-placed")
    out = _paged(placed, placed, limit, [F.col("__x_key")])
    return out.select("doc_id", F.col("__x_bytes").alias("n_bytes"), *_place())


def _place() -> list[Column | str]:
    return [F.col("__x_depth").alias("depth"), F.col("__x_bucket").alias("shard"), "page", "oversize"]


def _keyed() -> list[Column]:
    text = F.col("text")
    return [
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("__x_bytes"),
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.md5(text), F.lit("~")))), 1, 15), 16, 10).cast("bigint").alias("__x_key"),
    ]


def _paged(placed: DataFrame, rows: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """``rows`` with page and oversize. Buckets of ``placed`` that stayed overfull hold one
    key: they are cut into pages by position in ``order``."""
    over = placed.groupBy("__x_depth", "__x_bucket").agg(F.sum("__x_bytes").alias("__x_total"), F.max("__x_bytes").alias("__x_one")).where(F.col("__x_total") > limit)
    none = {"page": F.lit(0).cast("bigint"), "oversize": F.lit(False)}
    if over.isEmpty():
        return rows.withColumns(none)
    each = over.withColumn("__x_fit", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("__x_one"))).cast("bigint")).drop("__x_total")
    w = Window.partitionBy("__x_depth", "__x_bucket").orderBy(*order)
    paged = rows.join(each, ["__x_depth", "__x_bucket"]).withColumn("page", F.floor((F.row_number().over(w) - 1) / F.col("__x_fit")).cast("bigint")).withColumn("oversize", F.col("__x_bytes") > limit)
    whole = rows.join(each, ["__x_depth", "__x_bucket"], "left_anti").withColumns(none)
    return whole.unionByName(paged.drop("__x_one", "__x_fit"))


def place(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All columns of ``docs`` with depth, shard, page and oversize, one row a document."""
    clash = {c.lower() for c in docs.columns} & {"depth", "shard", "page", "oversize"}
    if clash:
        raise ValueError(f"columns have the names of a shard's: {sorted(clash)}")
    light = materialize(docs.select(*_keyed()), "op9-keys")
    levels = directory(light, limit)
    # Equal keys are ordered by the whole row, so that a task that runs again gives the same pages.
    inner, _ = shielded(docs, "doc_id", "text")
    order = [F.col("__x_key"), F.to_json(F.struct(*[F.col(c) for c in inner.columns]))]
    out = _paged(locate(light, levels), locate(inner.select("*", *_keyed()), levels), limit, order)
    return out.select(*[F.col(i).alias(n) for i, n in zip(inner.columns, docs.columns)], *_place())


def save(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write the shards: Parquet files under ``folder``/depth=/shard=/page=, one a page, with
    all columns of ``docs``. ``folder`` must not exist; the text is shuffled once."""
    keys = ["depth", "shard", "page"]
    placed = place(docs, limit).drop("oversize")
    placed.repartition(*keys).sortWithinPartitions(*keys).write.partitionBy(*keys).parquet(folder)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op9_sharding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a limit that splits small tables too."""
    return shard(table(spark, sf_dir, "documents"), SPLIT)


SPLIT = 32 << 10


def _oracle(limit: int) -> str:
    return f"""
WITH k AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || coalesce(md5(text), '~')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT rid, d, h >> (60 - d) AS prefix, n_bytes, h FROM k CROSS JOIN (SELECT CAST(unnest(range(0, 25)) AS INT) AS d)),
s AS (SELECT d, prefix, sum(n_bytes) AS total, min(h) = max(h) AS one FROM p GROUP BY d, prefix),
best AS (SELECT p.rid, min(p.d) AS depth FROM p JOIN s ON p.d = s.d AND p.prefix = s.prefix WHERE s.total <= {limit} OR s.one GROUP BY p.rid),
b AS (SELECT *, h >> (60 - depth) AS shard FROM k JOIN best USING (rid)),
w AS (SELECT *, sum(n_bytes) OVER x > {limit} AS over, greatest(1, {limit} // greatest(max(n_bytes) OVER x, 1)) AS fit, row_number() OVER (PARTITION BY depth, shard ORDER BY h) AS place FROM b WINDOW x AS (PARTITION BY depth, shard))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, depth, shard, CAST(CASE WHEN over THEN (place - 1) // fit ELSE 0 END AS BIGINT) AS page, over AND n_bytes > {limit} AS oversize FROM w"""


ORACLE, SPLIT_ORACLE = _oracle(LIMIT), _oracle(SPLIT)
