"""The queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import op1, op7, op11, op13
from .op2 import op2_source_mix
from .op3 import op3_language_id
from .op4 import op4_minhash_near_dedup
from .op5 import op5_substring_dedup
from .op6 import op6_best_fit_packing
from .op8 import op8_transport_streams
from .op9 import op9_license_scan
from .op10 import op10_embedding_near_dedup
from .op12 import op12_token_id_files

QUERIES = {
    "op1_chat_snapshots": op1.op1_chat_snapshots,
    "op2_source_mix": op2_source_mix,
    "op3_language_id": op3_language_id,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7.op7_url_filter,
    "op8_transport_streams": op8_transport_streams,
    "op9_license_scan": op9_license_scan,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_merkle_manifest": op11.op11_merkle_manifest,
    "op12_token_id_files": op12_token_id_files,
    "op13_prefix_trie": op13.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_chat_snapshots": op1.ORACLE,
    "op7_url_filter": op7.ORACLE,
    "op11_merkle_manifest": op11.ORACLE,
    "op13_prefix_trie": op13.ORACLE,
}
