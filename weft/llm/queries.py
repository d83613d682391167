"""Queries of the text operators and their SQL twins."""

from __future__ import annotations

from weft.llm.bpe import op3_byte_bpe
from weft.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from weft.llm.html_text import op4_html_text
from weft.llm.katz import op9_katz_backoff
from weft.llm.langid import op1_language_id
from weft.llm.packing import op2_best_fit_packing
from weft.llm.quality import op7_quality_bands
from weft.llm.rollup import op6_token_rollup
from weft.llm.simhash import op10_simhash
from weft.llm.warc import OP5_SQL, op5_warc_round_trip

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_html_text": op4_html_text,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_token_rollup": op6_token_rollup,
    "op7_quality_bands": op7_quality_bands,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_simhash": op10_simhash,
}

ORACLES = {
    "op5_warc_round_trip": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
}
