"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op9_nearest_neighbours
from .bpe import op6_bpe
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .language_id import op5_language_id
from .packing import op8_packing
from .pii import op7_pii
from .secret_scan import op3_secret_scan
from .simhash import op4_simhash_near_dedup
from .toxicity import op2_toxicity
from .warc import OP1_SQL, op1_warc_derivatives

QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {"op1_warc_derivatives": OP1_SQL, "op10_exact_dedup": OP10_SQL}
