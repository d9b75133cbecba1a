"""Extendible-hashing directory, built level by level with grouped aggregation.

Keys are the top ``BITS`` bits of a hash. The directory starts at the global depth
that the byte total asks for; a bucket is the shallowest prefix whose rows fit the
limit, so only overfull buckets are split on another bit. Where a slot of the
directory is itself overfull, the directory doubles (``STEP`` bits at a time) for
the keys of those slots alone, until every bucket fits or cannot be split because
its keys are all equal.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

BITS = 60
STEP = 6


def _prefix(bits):
    return F.expr(f"CAST(shiftright(__x_key, {BITS} - ({bits})) AS BIGINT)")


def _leaves(keys: DataFrame, bits: int, top: int, limit: int) -> DataFrame:
    """(slot, depth or null): for each slot of ``bits`` bits the shallowest prefix of
    at least ``top`` bits that fits."""
    hist = keys.groupBy(_prefix(bits).alias("__x_slot")).agg(F.sum("__x_bytes").alias("__x_sum"), F.min("__x_key").alias("__x_lo"), F.max("__x_key").alias("__x_hi"))
    hist = materialize(hist, "directory-hist")
    ladder = hist.withColumn("__x_d", F.explode(F.sequence(F.lit(top), F.lit(bits)))).withColumn("__x_p", F.expr(f"shiftright(__x_slot, {bits} - __x_d)"))
    full = ladder.groupBy("__x_d", "__x_p").agg(F.sum("__x_sum").alias("__x_total"), F.min("__x_lo").alias("__x_plo"), F.max("__x_hi").alias("__x_phi"))
    # A bucket of one key cannot be split further: it ends where it is met first.
    done = full.where((F.col("__x_total") <= limit) | (F.col("__x_plo") == F.col("__x_phi")))
    return ladder.join(done, ["__x_d", "__x_p"], "left").groupBy("__x_slot").agg(F.min(F.when(F.col("__x_total").isNotNull(), F.col("__x_d"))).alias("__x_depth"))


def directory(keys: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Levels of the directory of ``keys`` (__x_key, __x_bytes): (bits, (slot, depth)).

    A key's bucket is given by the first level whose slot has a depth.
    """
    total = keys.agg(F.sum("__x_bytes")).first()[0] or 0
    bits = min(24, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    levels, top, rest = [], 0, keys
    while True:
        level = materialize(_leaves(rest, bits, top, limit), "directory")
        levels.append((bits, level))
        open_slots = level.where("__x_depth IS NULL").select("__x_slot")
        if bits == BITS or open_slots.isEmpty():
            return levels
        rest = rest.withColumn("__x_slot", _prefix(bits)).join(small(open_slots), "__x_slot", "left_semi").drop("__x_slot")
        top, bits = bits + 1, min(BITS, bits + STEP)


def locate(df: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``df`` with __x_depth and __x_bucket (the prefix) of its __x_key."""
    depth = F.lit(None).cast("int")
    for i, (bits, level) in enumerate(levels):
        side = small(level.where("__x_depth IS NOT NULL").select(F.col("__x_slot").alias(f"__x_s{i}"), F.col("__x_depth").alias(f"__x_d{i}")))
        df = df.withColumn(f"__x_slot{i}", _prefix(bits)).join(side, F.col(f"__x_slot{i}") == F.col(f"__x_s{i}"), "left").drop(f"__x_slot{i}", f"__x_s{i}")
        depth = F.coalesce(depth, F.col(f"__x_d{i}"))
    out = df.withColumn("__x_depth", depth).drop(*[f"__x_d{i}" for i in range(len(levels))])
    return out.withColumn("__x_bucket", _prefix("__x_depth"))
