"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from mishap.llm import audit, codes, decontaminate, lm, minhash, mixing, packing, quality, substrings, tokens, topk, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_lm_score": lm.op2_lm_score,
    "op3_top_k": topk.op3_top_k,
    "op4_suffix_dedup": substrings.op4_suffix_dedup,
    "op5_near_dedup": minhash.op5_near_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_quality": quality.op10_quality,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_pack": packing.op12_pack,
    "op13_source_audit": audit.op13_source_audit,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_lm_score": lm.OP2_SQL,
    "op3_top_k": topk.OP3_SQL,
    "op4_suffix_dedup": substrings.OP4_SQL,
    "op5_near_dedup": minhash.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op13_source_audit": audit.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
