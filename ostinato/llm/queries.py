"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from .embdedup import OP8_SQL, op8_embedding_dedup
from .fim import OP12_SQL, op12_fill_in_middle
from .langid import op2_langid
from .linededup import OP4_SQL, op4_line_dedup
from .mixing import op5_mixing
from .packing import op1_packing
from .pii import op6_pii
from .quality import OP3_SQL, op3_quality
from .simhash import op9_simhash
from .substring import OP10_SQL, op10_substring
from .tokencount import op11_token_counts
from .tokenfiles import op7_token_files
from .vq import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_packing": op1_packing,
    "op2_langid": op2_langid,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_token_files": op7_token_files,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_simhash": op9_simhash,
    "op10_substring": op10_substring,
    "op11_token_counts": op11_token_counts,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op3_quality": OP3_SQL, "op4_line_dedup": OP4_SQL, "op8_embedding_dedup": OP8_SQL, "op10_substring": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_vector_codes": OP13_SQL}
