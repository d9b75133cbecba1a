"""A corpus pipeline of five stages over ``documents``.

quality classifier -> exact dedup -> n-gram Jaccard join -> mixing -> SentencePiece.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the
stage before it kept. ``run`` writes each stage's result as Parquet in the shared folder
and reads it back as the next one's ``docs``. All stages but the last return the columns
of ``documents``; the last returns the tokens. Nulls, empty and long texts, repeated rows and
extra columns are treated as the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silicore.llm import exact_dedup, jaccard_join, mixing, quality, sentencepiece_bpe
from silicore.llm.common import WRITTEN, discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, by the evidence that needs no Python."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), words=False)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of tokens in the target mixture of sources, as documents."""
    return mixing.mix_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, n_tokens) of every document's piece of every block."""
    return sentencepiece_bpe.encode(mixing.by_document(docs), keep=("doc_id", "source", "lang"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", tokens_stage),
]

#: The last stage has no SQL form; tests hold it against the library and a decoded round trip.
ORACLE_SQL = None

#: The rows that the first four stages give, in DuckDB SQL, held against them in the tests.
BEFORE_TOKENS_SQL = f"""WITH RECURSIVE {quality.sql(words=False)},
kept1 AS (SELECT doc_id, text, lang, source, n_chars FROM op1_out WHERE post >= {quality.THRESHOLD}),
kept2 AS (SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place FROM kept1) WHERE text IS NULL OR place = 1),
{jaccard_join.sql("kept2")},
near0 AS (SELECT a AS x, b AS y FROM op10_pair UNION SELECT b, a FROM op10_pair),
reach AS (SELECT x AS sid, x AS other FROM near0 UNION SELECT r.sid, n.y FROM reach r JOIN near0 n ON r.other = n.x),
comp AS (SELECT s.doc_id, coalesce(r.least, s.sid) AS grp FROM op10_set s LEFT JOIN (SELECT sid, min(other) AS least FROM reach GROUP BY sid) r USING (sid)),
keeper AS (SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY grp) AS first FROM comp),
kept3 AS (SELECT k.* FROM kept2 k LEFT JOIN keeper USING (doc_id) WHERE coalesce(first, true)),
{mixing.sql("kept3")}
SELECT doc_ids[1] AS doc_id, text, lang, source, length(text) AS n_chars FROM op2_out"""


def run(spark: SparkSession, sf_dir: str, stages: int = len(STAGES)) -> DataFrame:
    """The result of the first ``stages`` stages, all by default.

    A stage's own tables and its input are removed once its result is written; what the
    result names in its schema (the mixture's blocks) stays."""
    docs = table(spark, sf_dir, "documents")
    outer = WRITTEN.set([])
    try:
        for i, (_, stage) in enumerate(STAGES[:stages]):
            docs = stage(spark, docs, sf_dir)
            if i < stages - 1:
                docs = materialize(docs, f"stage-{i + 1}")
                *old, result = WRITTEN.get()
                named = docs.schema.json()
                discard(spark, [path for path in old if path not in named])
                WRITTEN.set([result])
    finally:
        WRITTEN.reset(outer)
    return docs


def before_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gets: the rows that ``BEFORE_TOKENS_SQL`` gives."""
    return run(spark, sf_dir, len(STAGES) - 1)
