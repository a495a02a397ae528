"""Registered queries and oracles of the training-data operators."""

from __future__ import annotations

from crawlscope.llm import (chat, decontaminate, filteraudit, jaccard, lines, packing, quality, repair, suffix, topk,
                            toxicity, urlfilter, warc)

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_suffix_array_dedup": suffix.op5_suffix_array_dedup,
    "op6_url_filters": urlfilter.op6_url_filters,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_warc": warc.op11_warc,
    "op12_filter_interaction_audit": filteraudit.op12_filter_interaction_audit,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLES = {
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op6_url_filters": urlfilter.ORACLE_SQL,
    "op7_ngram_jaccard": jaccard.ORACLE_SQL,
    "op8_exact_topk": topk.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_filter_interaction_audit": filteraudit.ORACLE_SQL,
    "op13_conversation_repair": repair.ORACLE_SQL,
}
