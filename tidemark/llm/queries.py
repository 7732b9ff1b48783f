"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from tidemark.llm.decontamination import OP2_SQL, op2_decontamination
from tidemark.llm.langid import op10_language_id
from tidemark.llm.media import op4_media
from tidemark.llm.minhash import OP7_SQL, op7_near_dedup
from tidemark.llm.mixing import OP6_SQL, op6_mixing
from tidemark.llm.prefix_doubling import op9_suffix_array_dedup
from tidemark.llm.quality import op5_quality
from tidemark.llm.records import op8_token_records
from tidemark.llm.suffix_trees import OP3_SQL, op3_suffix_tree_dedup
from tidemark.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_tree_dedup": op3_suffix_tree_dedup,
    "op4_media": op4_media,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_records": op8_token_records,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op3_suffix_tree_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op7_near_dedup": OP7_SQL}
