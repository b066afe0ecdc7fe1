"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_formatting
from .decontam import op10_benchmark_decontamination
from .lm_score import op4_lm_scoring
from .mixing import OP3_SQL, op3_mixing
from .pii import op7_pii
from .quality import op5_quality_rules
from .simhash import op8_simhash_near_dedup
from .substring_dedup import op2_substring_dedup
from .tokens import op9_token_output
from .urls import op6_url_filters

QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_substring_dedup, op3_mixing, op4_lm_scoring, op5_quality_rules, op6_url_filters, op7_pii, op8_simhash_near_dedup, op9_token_output, op10_benchmark_decontamination)}
SQL = {"op1_chat_formatting": OP1_SQL, "op3_mixing": OP3_SQL}
