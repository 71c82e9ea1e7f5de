"""The registered queries of the corpus operators."""

from __future__ import annotations

from tessella.llm import packing, quality, simhash, substrings, tokens, toxicity, vectors, warc

QUERIES = {
    "op1_bpe_roundtrip": tokens.op1_bpe_roundtrip,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_topk": vectors.op4_topk,
    "op5_embedding_dedup": vectors.op5_embedding_dedup,
    "op6_quality": quality.op6_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op9_warc": warc.op9_warc,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES: dict[str, str] = {
    "op3_substring_dedup": substrings.ORACLE_SQL,
    "op4_topk": vectors.TOPK_SQL,
    "op5_embedding_dedup": vectors.NEAR_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
