"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from lattica.llm.ctw import op6_lm_scoring
from lattica.llm.html_text import op2_html_text
from lattica.llm.jaccard import OP8_SQL, op8_jaccard_join
from lattica.llm.langid import op4_language_id
from lattica.llm.line_dedup import OP1_SQL, op1_line_dedup
from lattica.llm.mixing import OP3_SQL, op3_source_mixing
from lattica.llm.packing import op9_best_fit_packing
from lattica.llm.token_files import op7_token_files
from lattica.llm.topk import OP5_SQL, op5_exact_topk
from lattica.llm.vamana import op10_ann_graph

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_text": op2_html_text,
    "op3_source_mixing": op3_source_mixing,
    "op4_language_id": op4_language_id,
    "op5_exact_topk": op5_exact_topk,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_token_files": op7_token_files,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ann_graph": op10_ann_graph,
}
ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_source_mixing": OP3_SQL,
    "op5_exact_topk": OP5_SQL,
    "op8_jaccard_join": OP8_SQL,
}
