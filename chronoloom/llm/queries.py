"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .bytebpe import op11_byte_bpe
from .decontaminate import op7_benchmark_decontamination
from .licenses import OP3_SQL, op3_license_scans
from .linededup import OP5_SQL, op5_line_dedup
from .packing import op10_best_fit_packing
from .pii import op9_pii
from .quality import op6_quality_rules
from .sharding import OP2_SQL, op2_sharding
from .simhash import op1_simhash
from .substring import OP4_SQL, op4_substring_dedup
from .urlfilter import op8_url_filters

QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_sharding, op3_license_scans, op4_substring_dedup, op5_line_dedup, op6_quality_rules, op7_benchmark_decontamination, op8_url_filters, op9_pii, op10_best_fit_packing, op11_byte_bpe, op12_token_alignment)
}
ORACLES = {"op2_sharding": OP2_SQL, "op3_license_scans": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL}
