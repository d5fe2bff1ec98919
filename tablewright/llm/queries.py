"""Queries over the driver tables, one per operator, with SQL where SQL can say the same."""

from __future__ import annotations

from .decontaminate import OP6_SQL, op6_benchmark_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .html_extract import op4_html_extraction
from .language_id import op8_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .minhash_dedup import op10_minhash_dedup
from .mixing import op5_source_mixing
from .quality_classifier import op2_quality_classifier
from .quality_rules import op7_quality_rules
from .token_alignment import op13_token_alignment
from .token_counts import op12_token_counts
from .token_output import op3_token_output
from .url_filters import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_output": op3_token_output,
    "op4_html_extraction": op4_html_extraction,
    "op5_source_mixing": op5_source_mixing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
}
