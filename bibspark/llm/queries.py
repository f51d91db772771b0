"""The subpackage's registered queries and their oracle SQL."""

from __future__ import annotations

from bibspark.llm.collocations import ORACLE_OP12, op12_phrase_collocations
from bibspark.llm.embedding_dedup import op3_embedding_near_dedup
from bibspark.llm.fingerprint import op7_document_fingerprints
from bibspark.llm.html_text import op13_html_extraction
from bibspark.llm.lm_scoring import op4_lm_scoring
from bibspark.llm.mixing import ORACLE_OP1, op1_source_mixing
from bibspark.llm.packing import op8_best_fit_packing
from bibspark.llm.pii import op5_pii_surrogates
from bibspark.llm.simhash import op9_simhash_near_dedup
from bibspark.llm.substring_dedup import op10_substring_dedup
from bibspark.llm.suffix_dedup import op2_suffix_array_dedup
from bibspark.llm.toxicity import op6_toxicity
from bibspark.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_suffix_array_dedup,
        op3_embedding_near_dedup,
        op4_lm_scoring,
        op5_pii_surrogates,
        op6_toxicity,
        op7_document_fingerprints,
        op8_best_fit_packing,
        op9_simhash_near_dedup,
        op10_substring_dedup,
        op11_embedding_whitening,
        op12_phrase_collocations,
        op13_html_extraction,
    )
}

#: Where SQL is fast on whole tables; the others are tested against brute force in tests/llm.
ORACLE_SQL = {"op1_source_mixing": ORACLE_OP1, "op12_phrase_collocations": ORACLE_OP12}
