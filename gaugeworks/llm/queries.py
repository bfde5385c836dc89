"""The training-data queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, quality_rules
from .chat import op3_chat
from .classifier import op8_classifier
from .embedding_dedup import op7_near_copies
from .mixing import op4_mixing
from .ngram_join import op10_ngram_join
from .packing import op6_packing
from .pii import op9_pii
from .quality_rules import op5_quality_rules
from .suffix_dedup import op1_suffix_dedup
from .url_rules import op2_url_rules

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_rules": op2_url_rules,
    "op3_chat": op3_chat,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_near_copies": op7_near_copies,
    "op8_classifier": op8_classifier,
    "op9_pii": op9_pii,
    "op10_ngram_join": op10_ngram_join,
}

ORACLES = {"op3_chat": chat.ORACLE, "op5_quality_rules": quality_rules.ORACLE}
