"""Registered queries of this package and their oracle SQL, where SQL can express the result."""

from __future__ import annotations

from ridegauge.llm import align, bpe, bytebpe, dedup, langid, lm, packing, quality, rules, sharding, simhash, turns, urls

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_classifier,
        urls.op2_url_filters,
        dedup.op3_exact_dedup,
        sharding.op4_sharding,
        rules.op5_quality_rules,
        langid.op6_language_id,
        bpe.op7_bpe,
        simhash.op8_simhash_near_dedup,
        lm.op9_lm_scoring,
        packing.op10_packing,
        align.op11_tokenizer_alignment,
        bytebpe.op12_byte_bpe,
        turns.op13_conversation_repair,
    )
}
ORACLES = {"op2_url_filters": urls.SQL, "op3_exact_dedup": dedup.SQL, "op4_sharding": sharding.SQL}
