"""The queries of this package and, where SQL can state them, their SQL for DuckDB."""

from __future__ import annotations

from .ann import op4_nearest
from .bpe import op7_bpe
from .fingerprints import op2_fingerprints
from .licenses import OP8_SQL, op8_license_scan
from .minhash import op1_minhash_dedup
from .mixing import OP3_SQL, op3_mixing
from .sharding import OP9_SQL, op9_sharding
from .substring import op10_substring_dedup
from .toxicity import op5_toxicity
from .warc import OP6_SQL, op6_warc_audit

QUERIES = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_fingerprints, op3_mixing, op4_nearest, op5_toxicity, op6_warc_audit, op7_bpe, op8_license_scan, op9_sharding, op10_substring_dedup)
}

ORACLE_SQL = {"op3_mixing": OP3_SQL, "op6_warc_audit": OP6_SQL, "op8_license_scan": OP8_SQL, "op9_sharding": OP9_SQL}
