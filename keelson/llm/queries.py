"""The registered queries of this package, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from keelson.llm import (alignment, bpe, chat_format, conversation_repair, exact_dedup, minhash, mixing, quality, simhash,
                         substring_dedup, suffix_dedup, topk, url_filter)

QUERIES = {
    "op1_preference_format": chat_format.op1_preference_format,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_quality": quality.op3_quality,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
}

ORACLE = {
    "op1_preference_format": chat_format.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op13_minhash_dedup": minhash.ORACLE,
}
