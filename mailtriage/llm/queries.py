"""The operators' queries and their DuckDB SQL, where SQL can express them."""
from __future__ import annotations

from . import (alignment, chat, fingerprint, hard_negatives, langid, lattice, line_dedup, mixing, packing, quality,
               secrets, sharding, simhash)

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_secret_scan": secrets.query,
    "op3_line_dedup": line_dedup.query,
    "op4_simhash": simhash.query,
    "op5_packing": packing.query,
    "op6_fingerprints": fingerprint.query,
    "op7_sharding": sharding.query,
    "op8_language_id": langid.query,
    "op9_chat": chat.query,
    "op10_mixing": mixing.query,
    "op11_alignment": alignment.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_embedding_dedup": lattice.query,
}

ORACLE = {
    "op1_quality_rules": quality.ORACLE,
    "op2_secret_scan": secrets.ORACLE,
    "op9_chat": chat.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
