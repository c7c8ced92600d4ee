"""Queries of this subpackage with their SQL counterparts (None where SQL cannot say it)."""

from __future__ import annotations

from colsight.llm.bpe import op3_bpe
from colsight.llm.chat_format import op5_chat_format
from colsight.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from colsight.llm.decontamination import op6_decontamination
from colsight.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from colsight.llm.language_id import op9_language_id
from colsight.llm.line_dedup import OP8_SQL, op8_line_dedup
from colsight.llm.lm_scoring import OP4_SQL, op4_lm_scoring
from colsight.llm.minhash_dedup import OP1_SQL, op1_minhash_dedup
from colsight.llm.nearest import op12_nearest_neighbours
from colsight.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from colsight.llm.vector_codes import OP13_SQL, op13_vector_codes
from colsight.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_minhash_dedup": (op1_minhash_dedup, OP1_SQL),
    "op2_substring_dedup": (op2_substring_dedup, OP2_SQL),
    "op3_bpe": (op3_bpe, None),
    "op4_lm_scoring": (op4_lm_scoring, OP4_SQL),
    "op5_chat_format": (op5_chat_format, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_warc": (op10_warc, OP10_SQL),
    "op11_conversation_repair": (op11_conversation_repair, OP11_SQL),
    "op12_nearest_neighbours": (op12_nearest_neighbours, None),
    "op13_vector_codes": (op13_vector_codes, OP13_SQL),
}
