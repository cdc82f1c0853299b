"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .exact_dedup import OP2_SQL, op2_exact_dedup
from .forest import op3_forest
from .language import op7_language
from .main_text import op6_main_text
from .packing import op4_packing
from .pii import op1_private
from .simhash import op9_simhash
from .sampling import op5_sampling
from .substring_dedup import op10_substrings
from .warc_store import OP8_SQL, op8_warc

QUERIES = {
    "op1_private": op1_private,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_forest": op3_forest,
    "op4_packing": op4_packing,
    "op6_main_text": op6_main_text,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_substrings": op10_substrings,
    "op5_sampling": op5_sampling,
}

ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op8_warc": OP8_SQL,
}
