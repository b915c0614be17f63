"""The registered queries of the training-data operators, and SQL where it can state them."""

from __future__ import annotations

from .alignment import op12_alignment
from .bpe import op4_bpe_roundtrip
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .language_model import op10_lm_scores
from .license_scan import op2_license_scan
from .line_dedup import op5_line_dedup
from .ngram_join import op9_ngram_jaccard
from .packing import op1_packing
from .quality_rules import op3_quality_rules
from .run_detection import op13_periodic_runs
from .token_counts import op6_token_counts
from .toxicity import op8_toxicity
from .warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_lm_scores": op10_lm_scores,
    "op11_warc": op11_warc,
    "op12_alignment": op12_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op7_exact_dedup": OP7_SQL,
    "op11_warc": OP11_SQL,
}
