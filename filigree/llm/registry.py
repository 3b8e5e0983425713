"""The queries of this subpackage by name, and their SQL where it can express them."""

from __future__ import annotations

from filigree.llm.decontamination import op8_benchmark_decontamination
from filigree.llm.lm_scoring import op7_lm_scoring
from filigree.llm.near_dedup import OP9_SQL, op9_minhash_near_dedup
from filigree.llm.packing import op3_packing
from filigree.llm.quality_classifier import op5_quality_classifier
from filigree.llm.quality_rules import OP10_SQL, op10_quality_rules
from filigree.llm.secret_scan import OP4_SQL, op4_secret_scan
from filigree.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from filigree.llm.toxicity import op2_toxicity
from filigree.llm.url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filter": op6_url_filter,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op4_secret_scan": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
}
