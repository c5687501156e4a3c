"""The registered queries of this folder and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

import corpus_pipeline
from evalspark.llm.conversations import op11_conversation_repair
from evalspark.llm.decontaminate import op4_benchmark_decontamination
from evalspark.llm.exact import op12_exact_dedup
from evalspark.llm.filter_audit import op13_filter_interaction_audit
from evalspark.llm.language_model import op3_ngram_trie_scores
from evalspark.llm.oracle import ORACLE
from evalspark.llm.packing import op1_best_fit_packing
from evalspark.llm.quality import op9_quality_rules
from evalspark.llm.secret_scan import op10_secret_scan
from evalspark.llm.simhash import op7_simhash_near_dedup
from evalspark.llm.substrings import op6_substring_dedup
from evalspark.llm.token_counts import op5_token_counts
from evalspark.llm.token_files import op8_token_id_output
from evalspark.llm.warc import op2_warc_derivatives

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_ngram_trie_scores": op3_ngram_trie_scores,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_id_output": op8_token_id_output,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["ORACLE", "QUERIES"]
