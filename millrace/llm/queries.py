"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op7_bpe
from .chat_format import OP11_SQL, op11_chat_format
from .decontamination import OP5_SQL, op5_decontamination
from .html_extraction import op6_html_extraction
from .jaccard_join import op3_jaccard_join
from .line_dedup import OP1_SQL, op1_line_dedup
from .lm_scoring import op8_lm_scoring
from .media import op2_media_columns
from .quality import op9_quality
from .ranked_search import OP13_SQL, op13_ranked_search
from .spelling import op12_spelling_variants
from .token_counts import op10_token_counts
from .toxicity import op4_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_media_columns, op3_jaccard_join, op4_toxicity, op5_decontamination, op6_html_extraction, op7_bpe, op8_lm_scoring, op9_quality, op10_token_counts, op11_chat_format, op12_spelling_variants, op13_ranked_search)}


def oracle_sql() -> dict:
    return {"op1_line_dedup": OP1_SQL, "op5_decontamination": OP5_SQL, "op11_chat_format": OP11_SQL, "op13_ranked_search": OP13_SQL}
