"""Exact top-k search in three phases with a uniform threshold.

A query asks for the k vectors of largest inner product among all others. The registered
queries ask for every vector whose vec_id is divisible by ``ASKED``. A vector is split
over ``SLICES`` nodes by dimension; a score is the sum of the nodes' partial scores.

  1. Each node lists, for every query, its k best partial scores in each block of
     objects. The listed objects' whole scores give a cutoff t: the k-th best of
     them, which the answer cannot fall below.
  2. The cutoff goes back to the nodes. An object that reaches t has a partial score
     of at least t / SLICES at some node, so each node collects the entries that do.
  3. The collected entries' whole scores are computed exactly, in double precision,
     and the k best taken. No other object can be among them.

Defined results
  * ties are broken by the smaller vec_id; scores are compared after rounding to nine
    decimals, so that equal vectors tie;
  * a row is not its own answer: rows with the query's vec_id are left out;
  * null vectors, vectors with a null or non-finite entry, empty vectors and rows with
    a null vec_id neither ask nor answer; vectors of different lengths are not compared;
  * repeated rows (same id and vector) count once; of rows with one id and different
    vectors each asks, under its id;
  * fewer than k other vectors: all of them; an empty table: an empty result;
  * extra columns are ignored.

Vectors travel as blocks of ``BLOCK`` rows, so that a task does a matrix product for the
bytes it reads. The pairs of blocks are a cartesian product of the written block
table; nothing is broadcast. Single-precision products are used to select only, with
a margin beyond their error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K = 10
ASKED = 50
SLICES = 2
BLOCK = 2048
#: Pairs of blocks that a task takes, about.
PAIRS = 16


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("__v"), ok.alias("__ok"), F.size("embedding").alias("__dim")).where("__ok").drop("__ok").distinct()


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """(dim, part, ids, data): up to ``block`` vectors of one length, as little-endian doubles."""
    rows = materialize(_usable(vectors), "op4-vectors")
    many = materialize(rows.groupBy("__dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("__n")), "op4-counts")
    part = F.pmod(F.xxhash64("vec_id", "__v"), F.col("__n")).cast("int")
    keyed = rows.join(many, "__dim").withColumn("part", part)

    def stack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "ids": [pdf["vec_id"].to_numpy().tobytes()], "data": [np.stack(pdf["__v"].to_numpy()).astype("<f8").tobytes()]})

    out = materialize(keyed.groupBy("__dim", "part").applyInPandas(stack, "dim int, part int, ids binary, data binary"), "op4-stacked")
    return materialize(out.repartition(_spread(out)), "op4-blocks")


def _spread(blocks: DataFrame) -> int:
    """Partitions of either side of the product: a block each while there are few, then so
    that a task takes about ``PAIRS`` pairs; tasks grow with the pairs, without a cap."""
    n = blocks.count()
    return max(1, min(n, 64), -(-n // int(PAIRS**0.5)))


def _pairs(asking: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of queries with every block of objects: a cartesian product, so the
    tasks are the products of both sides' partitions. Lengths are compared by the tasks."""
    q = asking.select(*[F.col(c).alias(f"q_{c}") for c in asking.columns])
    return q.crossJoin(blocks.select(*[F.col(c).alias(f"x_{c}") for c in blocks.columns]))


def _alike(it: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for pdf in it:
        for _, row in pdf.iterrows():
            if row["q_dim"] == row["x_dim"]:
                yield row


def _load(row, side: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_data"], "<f8").reshape(-1, row["x_dim"])


def _nodes(dim: int, slices: int) -> list[slice]:
    cut = np.linspace(0, dim, min(slices, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """Single precision for the selecting products, unless they could overflow it."""
    return np.float32 if max(np.abs(q).max(), np.abs(x).max()) < 1e15 else np.float64


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 65_536):
        s = slice(a, a + 65_536)
        out[s] = np.einsum("ij,ij->i", q[i[s]], x[j[s]])
    return np.round(out, 9) + 0.0


def _best(qid: np.ndarray, i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The k best (score, then id) of every query i."""
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    return pd.DataFrame({"vec_id": qid[i[top]], "row": i[top], "hit_id": ids[top], "score": score[top]})


def _first_phase(it: Iterator[pd.DataFrame], k: int, slices: int) -> Iterator[pd.DataFrame]:
    for row in _alike(it):
        qid, q = _load(row, "q")
        xid, x = _load(row, "x")
        m, kind = min(k + 1, len(xid)), _kind(q, x)
        seen = []
        for node in _nodes(row["x_dim"], slices):
            part = q[:, node].astype(kind) @ x[:, node].astype(kind).T
            seen.append(np.argpartition(-part, m - 1, axis=1)[:, :m] if m < len(xid) else np.broadcast_to(np.arange(m), part.shape))
        i = np.repeat(np.arange(len(qid)), m * len(seen))
        j = np.concatenate(seen, axis=1).ravel()
        pair = np.unique(i * len(xid) + j)
        i, j = pair // len(xid), pair % len(xid)
        other = qid[i] != xid[j]
        i, j = i[other], j[other]
        yield _best(qid, i, xid[j], _exact(q, x, i, j), k).assign(q_dim=row["x_dim"], q_part=row["q_part"])[["q_part", "row", "score", "q_dim"]]


def _second_phase(it: Iterator[pd.DataFrame], k: int, slices: int) -> Iterator[pd.DataFrame]:
    for row in _alike(it):
        qid, q = _load(row, "q")
        xid, x = _load(row, "x")
        cut = np.full(len(qid), -np.inf)
        cut[np.asarray(row["q_rows"], int)] = row["q_cuts"]
        nodes, kind = _nodes(row["x_dim"], slices), _kind(q, x)
        norm = np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max() if len(x) else 0)
        level = np.nextafter((cut / len(nodes) - 1e-5 * norm - 1e-8).astype(kind), kind(-np.inf))
        keep = np.zeros((len(qid), len(xid)), bool)
        for node in nodes:
            keep |= q[:, node].astype(kind) @ x[:, node].astype(kind).T >= level[:, None]
        i, j = np.nonzero(keep)
        score = _exact(q, x, i, j)
        good = (score >= cut[i]) & (qid[i] != xid[j])
        i, j, score = i[good], j[good], score[good]
        yield _best(qid, i, xid[j], score, k).assign(q_dim=row["x_dim"], q_part=row["q_part"])[["q_dim", "q_part", "row", "vec_id", "hit_id", "score"]]


def search(vectors: DataFrame, k: int = K, slices: int = SLICES, block: int = BLOCK, asked: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): of all vectors the k best of every vector whose
    vec_id is divisible by ``asked``, rank from 1."""
    blocks = _blocks(vectors, block)
    queries = blocks if asked == 1 else _blocks(vectors.where(F.col("vec_id").cast("bigint") % asked == 0), block)
    lists = _pairs(queries, blocks).mapInPandas(lambda it: _first_phase(it, k, slices), "q_part int, row int, score double, q_dim int")
    w = Window.partitionBy("q_dim", "q_part", "row").orderBy(F.desc("score"))
    cut = lists.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).groupBy("q_dim", "q_part").agg(F.collect_list(F.struct("row", "score")).alias("c"))
    cut = materialize(cut.select("q_dim", "q_part", F.expr("transform(c, x -> x.row)").alias("rows"), F.expr("transform(c, x -> x.score)").alias("cuts")), "op4-cutoffs")
    cut = cut.withColumnsRenamed({"q_dim": "dim", "q_part": "part"})
    asking = queries.join(cut, ["dim", "part"], "left").withColumns({"rows": F.coalesce("rows", F.array().cast("array<int>")), "cuts": F.coalesce("cuts", F.array().cast("array<double>"))})
    hits = _pairs(asking.repartition(_spread(queries)), blocks).mapInPandas(lambda it: _second_phase(it, k, slices), "q_dim int, q_part int, row int, vec_id bigint, hit_id bigint, score double")
    best = Window.partitionBy("q_dim", "q_part", "row").orderBy(F.desc("score"), "hit_id")
    out = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("vec_id", "rank", F.col("hit_id").alias("neighbor_id"), (F.round(F.col("score") * 1e6) / 1e6).alias("score"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), asked=ASKED)


def op4_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with blocks so small that small tables have many."""
    return search(table(spark, sf_dir, "embeddings"), block=64, asked=ASKED)


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
p AS (SELECT row_number() OVER () AS rid, * FROM v),
s AS (SELECT q.rid, q.vec_id, x.vec_id AS neighbor_id, round(list_inner_product(q.e, x.e), 9) AS score FROM p q JOIN p x ON len(q.e) = len(x.e) AND q.vec_id <> x.vec_id WHERE q.vec_id % {ASKED} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, neighbor_id) AS INT) AS rank FROM s)
SELECT vec_id, rank, neighbor_id, round(score, 6) AS score FROM r WHERE rank <= {K}"""
