"""Mixing sources to target weights.

Documents of one (source, lang) are cut into token streams of bounded size, each
stream is packed into blocks of ``BLOCK`` tokens, and the blocks of a source are
numbered 0..n-1 from the streams' token counts alone. For every output shard a
multinomial draw says how many of its slots each source fills. The running number of
a slot within its source, modulo n, goes through a pseudorandom permutation of the
indices (a swap-or-not network, another one for each pass over the source), and
blocks and slots are joined by (source, index).

A token is a run of non-space characters with the white space before it; trailing
white space is a token too, and every document ends with one separator token, so the
blocks of a stream, concatenated, give its documents back exactly.

Defined results
  * null or empty text: no token, no block;
  * null source or lang: a source, or stream, of its own;
  * a stream's last block may hold fewer than ``BLOCK`` tokens; a document of any
    length spans as many blocks as it needs;
  * repeated rows and equal ids: packed as often as they occur, ordered by (doc_id
    nulls first, text);
  * weights: sources that the table lacks are ignored, sources without a weight get
    none; by default a source's weight is its block count to the power ``ALPHA``;
  * a source with fewer blocks than slots is passed through again (``epoch``); its draws
    travel in rows of at most ``EPOCHS`` passes, however many they are;
  * an empty table: no slots;
  * extra columns are ignored by ``mix``; ``mix_documents`` returns them as null.

The text is shuffled once, when streams gather: the plan is made of counts, and the
slots that drew a stream's blocks travel to the stream. Only where a source is passed
through more than ``EPOCHS`` times its blocks are spread again before they are repeated. The
number of slots is that of the blocks. Words are the tokens: the model's own would cost more
CPU time than this operator's budget has (figures in the README).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialize, small, stored, table

BLOCK = 512
SHARD = 1024
STREAM_BYTES = 4 << 20
ALPHA = 0.5
SEED = 20_240_501
ROUNDS = 24
PAGE = 4096
#: Passes over a source whose draws lie in one row.
EPOCHS = 64
EOD = "\n\n"

_P = 2147483647
_WS = r"[ \t\n\r\f]"
_TOKEN = rf"{_WS}*[^ \t\n\r\f]+|{_WS}+\z"
_NONE = "\u0001"
#: Metadata of a block's text: where the table of its documents lies.
BLOCKS = "op2-blocks"


def _mix(a: str, b: str, c: str, div: str) -> str:
    """SQL of a pseudorandom number below 2**31 - 1 from integers; b may exceed it."""
    h = f"((({a}) * 48271 + (({b}) % {_P}) * 69621 + (({b}) {div} {_P}) * 30269 + ({c}) * 39373 + 12345) % {_P})"
    h = f"(({h} * {h} + 7 * ({c}) + 1) % {_P})"
    return f"(({h} * 16807 + ({a})) % {_P})"


def _swap_round(x: str, r: str, key: str, n: str, div: str) -> str:
    """SQL of one round of the permutation of 0..n-1: x and its partner change places or not."""
    k = f"(({_mix(key, '11', r, div)} * 2147483648 + {_mix(key, '13', r, div)}) % ({n}))"
    partner = f"(({k} + ({n}) - {x}) % ({n}))"
    bit = f"({_mix(key, f'greatest({x}, {partner})', r, div)} {div} 65536) % 2"
    return f"CASE WHEN {bit} = 1 THEN {partner} ELSE {x} END"


def permuted(x: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The permutations' values at x: all rounds of ``_swap_round`` on whole columns."""

    def draw(b: np.ndarray | int, r: int) -> np.ndarray:
        h = (key * 48271 + (b % _P) * 69621 + (b // _P) * 30269 + r * 39373 + 12345) % _P
        h = (h * h + 7 * r + 1) % _P
        return (h * 16807 + key) % _P

    for r in range(ROUNDS):
        partner = ((draw(11, r) * 2147483648 + draw(13, r)) % n + n - x) % n
        x = np.where(draw(np.maximum(x, partner), r) // 65536 % 2 == 1, partner, x)
    return x


@F.pandas_udf(LongType())
def _permuted(x: pd.Series, key: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(permuted(x.to_numpy(), key.to_numpy(), n.to_numpy()))


def _streams(docs: DataFrame) -> DataFrame:
    """Light rows: the stream's keys and each document's tokens."""
    n = F.size(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))) + 1
    base = docs.where("text IS NOT NULL AND text <> ''")
    return base.select(_key("source").alias("__m_s"), _key("lang").alias("__m_l"), _spread().alias("__m_h"), F.octet_length("text").cast("bigint").alias("__m_b"), n.cast("bigint").alias("__m_n"))


def _key(c: str):
    return F.coalesce(F.col(c), F.lit(_NONE))


def _spread():
    return F.expr(f"coalesce((pmod(doc_id, {_P}) * 48271 + 11) % {_P}, 0)")


def _plan(docs: DataFrame, weights: dict[str, float] | None, shard: int) -> tuple[DataFrame, DataFrame, bool]:
    """Streams per (source, lang); for each stream and ``EPOCHS`` passes an array, by block, of
    the slots that drew it; and whether any source has more passes."""
    spark = docs.sparkSession
    light = materialize(_streams(docs), "op2-tokens")
    split = materialize(light.groupBy("__m_s", "__m_l").agg(F.ceil(F.sum("__m_b") / F.lit(float(STREAM_BYTES))).cast("bigint").alias("__m_g")), "op2-streams")
    blocks = light.join(small(split), ["__m_s", "__m_l"]).groupBy("__m_s", "__m_l", F.expr("__m_h % __m_g").alias("__m_i")).agg(F.ceil(F.sum("__m_n") / F.lit(float(BLOCK))).cast("bigint").alias("__m_k"))
    w = Window.partitionBy("__m_s").orderBy("__m_l", "__m_i").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(blocks.withColumn("__m_first", F.coalesce(F.sum("__m_k").over(w), F.lit(0)).cast("bigint")), "op2-first")

    size = first.groupBy("__m_s").agg(F.sum("__m_k").alias("__m_size"))
    given = {k if k is not None else _NONE: float(v) for k, v in (weights or {}).items()}
    wanted = F.pow(F.col("__m_size").cast("double"), F.lit(ALPHA))
    if weights is not None:
        table_ = spark.createDataFrame(list(given.items()), "__m_s string, __m_w double")
        size = size.join(F.broadcast(table_), "__m_s", "left").withColumn("__m_w", F.coalesce("__m_w", F.lit(0.0)))
    else:
        size = size.withColumn("__m_w", wanted)
    order = Window.orderBy("__m_s")  # one row a source
    total = Window.partitionBy()
    size = size.withColumn("__m_all", F.sum("__m_w").over(total)).withColumn("__m_slots", F.sum("__m_size").over(total))
    size = size.withColumn("__m_hi", F.floor(F.coalesce(F.try_divide(F.sum("__m_w").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("__m_all")), F.lit(0.0)) * 4294967296.0 + 0.5).cast("bigint"))
    size = materialize(size.withColumn("__m_lo", F.coalesce(F.lag("__m_hi").over(order), F.lit(0))), "op2-sources")

    head = size.agg(F.max("__m_slots"), F.max("__m_all")).first()
    n = int(head[0] or 0) if (head[1] or 0) > 0 else 0
    slots = spark.range(n).select(F.expr(f"id div {shard}").alias("shard"), F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint").alias("__m_u"))
    drawn = slots.join(small(size.select("__m_s", "__m_lo", "__m_hi")), (F.col("__m_u") >= F.col("__m_lo")) & (F.col("__m_u") < F.col("__m_hi")))
    counts = drawn.groupBy("shard", "__m_s").agg(F.count(F.lit(1)).alias("__m_c"))
    before = Window.partitionBy("__m_s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__m_base", F.coalesce(F.sum("__m_c").over(before), F.lit(0)).cast("bigint"))
    slot = counts.select("shard", "__m_s", F.explode(F.expr("sequence(__m_base, __m_base + __m_c - 1)")).alias("__m_j")).join(small(size.select("__m_s", "__m_size")), "__m_s")
    slot = slot.withColumn("epoch", F.expr("__m_j div __m_size"))
    slot = slot.withColumn("__m_key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), "__m_s", F.col("epoch").cast("string"))), 1, 7), 16, 10).cast("bigint"))
    slot = slot.withColumn("block", _permuted(F.expr("__m_j % __m_size"), "__m_key", "__m_size"))
    place = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws("|", "__m_s", F.col("__m_j").cast("string"))), "__m_s", "__m_j")
    slot = slot.withColumn("slot", (F.row_number().over(place) - 1).cast("bigint"))
    slot = slot.select("shard", "slot", "__m_s", "block", "epoch")

    # A stream's blocks are a range of indices: look it up by the range's pages.
    pages = first.withColumn("__m_page", F.explode(F.expr(f"sequence(__m_first div {PAGE}, (__m_first + __m_k - 1) div {PAGE})")))
    slot = slot.withColumn("__m_page", F.expr(f"block div {PAGE}")).join(pages, ["__m_s", "__m_page"]).where("block >= __m_first AND block < __m_first + __m_k")
    keys = ["__m_s", "__m_l", "__m_i"]
    passes = (F.col("epoch") / EPOCHS).cast("bigint").alias("__m_e")
    drawn = slot.groupBy(*keys, passes, (F.col("block") - F.col("__m_first")).alias("__m_b")).agg(F.collect_list(F.struct("shard", "slot", "block", "epoch")).alias("__m_d"))
    last = materialize(counts.groupBy("__m_s").agg(F.max(F.col("__m_base") + F.col("__m_c") - 1).alias("__m_j")), "op2-last")
    rows = size.join(small(last), "__m_s").select("__m_s", F.expr(f"sequence(0L, __m_j div __m_size div {EPOCHS})").alias("__m_es"))
    many = not rows.where("size(__m_es) > 1").isEmpty()
    every = first.join(small(rows), "__m_s").select("*", F.explode("__m_es").alias("__m_e")).withColumn("__m_b", F.explode(F.expr("sequence(0L, __m_k - 1)")))
    every = every.join(drawn, [*keys, "__m_e", "__m_b"], "left")
    plan = every.groupBy(*keys, "__m_e").agg(F.sort_array(F.collect_list(F.struct("__m_b", "__m_d"))).alias("__m_plan"))
    return split, materialize(plan, "op2-plan"), many


def _blocks(docs: DataFrame, split: DataFrame) -> DataFrame:
    """The packed blocks of every stream, partitioned by stream: block, lang, n_tokens, pieces."""
    rows = docs.where("text IS NOT NULL AND text <> ''").select(F.col("doc_id"), F.col("text"), F.col("lang"), _key("source").alias("__m_s"), _key("lang").alias("__m_l"), _spread().alias("__m_h"))
    rows = rows.join(small(split), ["__m_s", "__m_l"]).withColumn("__m_i", F.expr("__m_h % __m_g")).drop("__m_h", "__m_g")
    keys = ["__m_s", "__m_l", "__m_i"]
    rows = rows.repartition(*keys)
    tokens = F.concat(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)), F.array(F.lit(EOD)))
    w = Window.partitionBy(*keys).orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__m_n", F.size(tokens).cast("bigint")).withColumn("__m_end", F.sum("__m_n").over(w)).withColumn("__m_at", F.col("__m_end") - F.col("__m_n"))
    rows = rows.withColumn("__m_t", tokens)
    cut = f"""transform(sequence(__m_at div {BLOCK}, (__m_end - 1) div {BLOCK}), b -> struct(b AS b,
        array_join(slice(__m_t, int(greatest(b * {BLOCK} - __m_at, 0L) + 1), int(least((b + 1) * {BLOCK}, __m_end) - greatest(b * {BLOCK}, __m_at))), '') AS p,
        least((b + 1) * {BLOCK}, __m_end) - greatest(b * {BLOCK}, __m_at) AS c))"""
    pieces = rows.select(*keys, "lang", "doc_id", "__m_at", F.explode(F.expr(cut)).alias("__m_x"))
    return pieces.groupBy(*keys, F.col("__m_x.b").alias("__m_b")).agg(
        F.first("lang").alias("lang"), F.sum("__m_x.c").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("__m_at", F.col("__m_x.p").alias("p"), "doc_id"))).alias("__m_ps")
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, shard: int = SHARD) -> DataFrame:
    """(shard, slot, source, lang, block, epoch, doc_ids, text, n_tokens), one row a slot."""
    out = _slots(docs, weights, shard)
    return out.select("shard", "slot", "source", "lang", "block", "epoch", F.expr("transform(__m_ps, x -> x.doc_id)").alias("doc_ids"), _joined().alias("text"), "n_tokens")


def _joined():
    return F.expr("array_join(transform(__m_ps, x -> x.p), '')")


def _slots(docs: DataFrame, weights: dict[str, float] | None, shard: int = SHARD) -> DataFrame:
    """One row a slot, with the pieces of its block."""
    split, plan, many = _plan(docs, weights, shard)
    # The plan has one row a stream and is hashed on the blocks' own partitioning.
    out = _blocks(docs, split).join(plan.hint("shuffle_hash"), ["__m_s", "__m_l", "__m_i"])
    out = out.withColumn("__m_ds", F.expr("__m_plan[int(__m_b)].__m_d")).drop("__m_plan").where("__m_ds IS NOT NULL")
    if many:
        out = out.repartition("__m_s", "__m_l", "__m_i", "__m_b", "__m_e")
    out = out.select("*", F.explode("__m_ds").alias("__m_d"))
    source = F.when(F.col("__m_s") != _NONE, F.col("__m_s")).alias("source")
    return out.select("__m_d.shard", "__m_d.slot", source, "lang", "__m_d.block", "__m_d.epoch", "__m_ps", "n_tokens")


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The mixture as rows of the columns of ``docs``: each slot's block is a document
    whose id is that of the document it begins with.

    All documents of a block are in a table beside it, (shard, slot, key, pieces), whose
    path the field ``text`` has as metadata; ``by_document`` cuts the blocks by it."""
    spark = docs.sparkSession
    lens = F.expr("transform(__m_ps, x -> struct(x.doc_id AS doc_id, char_length(x.p) AS n))")
    made = {"doc_id": F.expr("__m_ps[0].doc_id"), "text": _joined(), "lang": F.col("lang"), "source": F.col("source"), "n_chars": F.char_length(_joined())}
    rows = _slots(docs, weights).select(*[made[c].cast(docs.schema[c].dataType).alias(c) for c in made if c in docs.columns], "shard", "slot", lens.alias("pieces"))
    path = stored(rows.withColumn("key", _block_key()), "op2-blocks")
    mixed = spark.read.parquet(path)
    note = lambda f: {"metadata": {BLOCKS: path}} if f.name == "text" else {}
    return mixed.select(*[(F.col(f.name) if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name, **note(f)) for f in docs.schema])


def _block_key():
    return F.md5(F.to_json(F.struct("doc_id", "source", "lang", "text")))


def by_document(blocks: DataFrame) -> DataFrame:
    """(doc_id, source, lang, text): the rows of ``mix_documents`` cut where another document
    begins, each piece under its own document's id; a block's pieces follow one another.
    Rows without a table of blocks, or not in it, are given as they are."""
    plain = blocks.select("doc_id", "source", "lang", "text")
    path = blocks.schema["text"].metadata.get(BLOCKS)
    if path is None:
        return plain
    # Blocks of one key look the same: rows of the key take their layouts in turn.
    one = blocks.sparkSession.read.parquet(path).groupBy("key", "pieces").agg(F.count(F.lit(1)).alias("n"))
    layouts = one.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "pieces"))).alias("__m_lay"))
    layouts = materialize(layouts, "op2-layouts")
    rows = plain.withColumn("key", _block_key())
    if layouts.where("size(__m_lay) > 1").isEmpty():
        rows = rows.withColumn("__m_r", F.lit(1))
    else:
        rows = rows.withColumn("__m_r", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    rows = rows.join(layouts, "key", "left")
    mine = """coalesce(get(filter(__m_lay, (v, i) -> aggregate(slice(__m_lay, 1, i + 1), 0L, (s, w) -> s + w.n) >= __m_r), 0), element_at(__m_lay, -1)).pieces"""
    rows = rows.withColumn("__m_p", F.coalesce(F.expr(mine), F.expr("array(struct(doc_id, char_length(text) AS n))")))
    cut = "transform(__m_p, (x, i) -> struct(x.doc_id AS doc_id, aggregate(slice(__m_p, 1, i), 0, (s, w) -> s + w.n) AS at, x.n AS n))"
    rows = rows.select("source", "lang", "text", F.explode(F.expr(cut)).alias("__m_x"))
    return rows.select(F.col("__m_x.doc_id").cast(blocks.schema["doc_id"].dataType).alias("doc_id"), "source", "lang", F.expr("substring(text, __m_x.at + 1, __m_x.n)").alias("text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_mixing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards so small that small tables fill many."""
    return mix(table(spark, sf_dir, "documents"), shard=32)


def sql(docs: str = "documents", shard: int = SHARD) -> str:
    """CTEs ending in ``op2_out`` over ``docs``."""
    body = _swap_round("x", "r", "key0", "size0", "//")
    return rf"""
op2_d AS (SELECT doc_id, text, lang, coalesce(source, chr(1)) AS s0, coalesce(lang, chr(1)) AS l0, coalesce(((((doc_id % {_P}) + {_P}) % {_P}) * 48271 + 11) % {_P}, 0) AS h0,
   list_concat(regexp_extract_all(text, '{_TOKEN}'), [chr(10) || chr(10)]) AS toks, row_number() OVER () AS rid FROM {docs} WHERE text IS NOT NULL AND text <> ''),
op2_g AS (SELECT s0, l0, CAST(ceil(sum(strlen(text)) / {float(STREAM_BYTES)}::DOUBLE) AS BIGINT) AS g FROM op2_d GROUP BY s0, l0),
op2_r AS (SELECT d.*, h0 % g AS i0, sum(len(toks)) OVER (PARTITION BY s0, l0, h0 % g ORDER BY doc_id NULLS FIRST, text, rid ROWS UNBOUNDED PRECEDING) - len(toks) AS at0 FROM op2_d d JOIN op2_g USING (s0, l0)),
op2_k AS (SELECT s0, l0, i0, CAST(ceil(sum(len(toks)) / {float(BLOCK)}::DOUBLE) AS BIGINT) AS k FROM op2_r GROUP BY s0, l0, i0),
op2_f AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY s0 ORDER BY l0, i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first0 FROM op2_k),
op2_tok AS (SELECT s0, l0, i0, lang, doc_id, at0, unnest(toks) AS tok, at0 + generate_subscripts(toks, 1) - 1 AS pos FROM op2_r),
op2_b AS (SELECT s0, first0 + pos // {BLOCK} AS block, min(lang) AS lang, string_agg(tok, '' ORDER BY pos) AS text, count(*) AS n_tokens FROM op2_tok JOIN op2_f USING (s0, l0, i0) GROUP BY s0, l0, i0, first0, pos // {BLOCK}),
op2_i AS (SELECT s0, block, list(doc_id ORDER BY at0) AS doc_ids FROM (SELECT DISTINCT s0, first0 + pos // {BLOCK} AS block, at0, doc_id FROM op2_tok JOIN op2_f USING (s0, l0, i0)) GROUP BY s0, block),
op2_z AS (SELECT s0, CAST(sum(k) AS BIGINT) AS size0, power(CAST(sum(k) AS DOUBLE), {ALPHA}::DOUBLE) AS w FROM op2_f GROUP BY s0),
op2_y AS (SELECT *, CAST(floor(sum(w) OVER (ORDER BY s0 ROWS UNBOUNDED PRECEDING) / sum(w) OVER () * 4294967296.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS hi FROM op2_z),
op2_x AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY s0), 0) AS lo FROM op2_y),
op2_u AS (SELECT id, CAST('0x' || substr(md5('{SEED}|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) AS u FROM (SELECT unnest(range((SELECT CAST(coalesce(sum(size0), 0) AS BIGINT) FROM op2_z))) AS id)),
op2_c AS (SELECT id // {shard} AS shard, s0, size0, count(*) AS c FROM op2_u JOIN op2_x ON u >= lo AND u < hi GROUP BY ALL),
op2_j AS (SELECT shard, s0, size0, unnest(range(base, base + c)) AS j FROM (SELECT *, CAST(coalesce(sum(c) OVER (PARTITION BY s0 ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM op2_c)),
op2_e AS (SELECT *, j // size0 AS epoch, CAST('0x' || substr(md5(concat_ws('|', '{SEED}', s0, CAST(j // size0 AS VARCHAR))), 1, 7) AS BIGINT) AS key0 FROM op2_j),
op2_s AS (SELECT *, list_reduce(range({ROUNDS}), lambda x, r: {body}, j % size0) AS block,
   row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', s0, CAST(j AS VARCHAR))), s0, j) - 1 AS slot FROM op2_e),
op2_out AS (SELECT s.shard, s.slot, CASE WHEN s0 <> chr(1) THEN s0 END AS source, b.lang, s.block, s.epoch, i.doc_ids, b.text, b.n_tokens FROM op2_s s JOIN op2_b b USING (s0, block) JOIN op2_i i USING (s0, block))"""


ORACLE = f"WITH {sql()} SELECT * FROM op2_out"
SHARDS_ORACLE = f"WITH {sql(shard=32)} SELECT * FROM op2_out"
