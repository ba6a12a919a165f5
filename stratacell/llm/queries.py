"""The queries of this subpackage and their SQL, for the entry point."""

from __future__ import annotations

from stratacell.llm.bpe import op2_bpe
from stratacell.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from stratacell.llm.near_dedup import op8_near_dedup
from stratacell.llm.packing import op10_packing
from stratacell.llm.perplexity import op7_quality_classifier
from stratacell.llm.quality_rules import OP1_SQL, op1_quality_rules
from stratacell.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from stratacell.llm.suffix_dedup import op3_suffix_dedup
from stratacell.llm.toxicity import op4_toxicity
from stratacell.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
}

SQL = {
    "op1_quality_rules": OP1_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op9_exact_dedup": OP9_SQL,
}
