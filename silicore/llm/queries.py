"""The ten registered queries, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, lm_scoring, mixing, quality, sentencepiece_bpe, sharding, topk, url_filter, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_warc": warc.op3_warc,
    "op4_topk": topk.op4_topk,
    "op5_sentencepiece": sentencepiece_bpe.op5_sentencepiece,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_sharding": sharding.op9_sharding,
    "op10_ngram_jaccard": jaccard_join.op10_ngram_jaccard,
    # Beside the production queries: small limits, at which small tables split too, and round trips.
    "op2_mixing_shards": mixing.op2_mixing_shards,
    "op3_warc_round_trip": warc.op3_warc_round_trip,
    "op4_topk_blocks": topk.op4_topk_blocks,
    "op5_sentencepiece_decoded": sentencepiece_bpe.op5_sentencepiece_decoded,
    "op6_exact_dedup_split": exact_dedup.op6_exact_dedup_split,
    "op9_sharding_split": sharding.op9_sharding_split,
}
ORACLES = {
    "op1_quality": quality.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op4_topk": topk.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_lm_scoring": lm_scoring.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op10_ngram_jaccard": jaccard_join.ORACLE,
    "op2_mixing_shards": mixing.SHARDS_ORACLE,
    "op3_warc_round_trip": warc.ROUND_TRIP_ORACLE,
    "op4_topk_blocks": topk.ORACLE,
    "op5_sentencepiece_decoded": sentencepiece_bpe.ROUND_TRIP_ORACLE,
    "op6_exact_dedup_split": exact_dedup.ORACLE,
    "op9_sharding_split": sharding.SPLIT_ORACLE,
}
