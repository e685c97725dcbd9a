"""The subpackage's registered queries."""

from __future__ import annotations

from hashtrend.llm.chat import op11_chat_format
from hashtrend.llm.cross_tokens import op13_cross_tokens
from hashtrend.llm.decontaminate import op5_decontamination
from hashtrend.llm.embed_dedup import op2_embedding_dedup
from hashtrend.llm.hmm_lm import op10_hmm_lm
from hashtrend.llm.html_wrapper import op7_html_extraction
from hashtrend.llm.jaccard import op9_jaccard_join
from hashtrend.llm.oracles import STATEMENTS
from hashtrend.llm.packing import op8_packing
from hashtrend.llm.quality import op6_quality
from hashtrend.llm.spelling import op12_spelling_variants
from hashtrend.llm.suffix_dedup import op1_suffix_dedup
from hashtrend.llm.token_counts import op3_token_counts
from hashtrend.llm.toxicity import op4_toxicity

QUERIES = {
    q.__name__: q
    for q in (
        op1_suffix_dedup,
        op2_embedding_dedup,
        op3_token_counts,
        op4_toxicity,
        op5_decontamination,
        op6_quality,
        op7_html_extraction,
        op8_packing,
        op9_jaccard_join,
        op10_hmm_lm,
        op11_chat_format,
        op12_spelling_variants,
        op13_cross_tokens,
    )
}

#: DuckDB statements for the queries that SQL can express on whole tables; the others are tested against brute force.
ORACLES: dict[str, str] = STATEMENTS
