"""The numbered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from ledgerlark.llm import decontamination, hard_negatives, licenses, merkle, near_dedup, quality
from ledgerlark.llm.decontamination import op13_decontamination
from ledgerlark.llm.fingerprints import op5_fingerprints
from ledgerlark.llm.hard_negatives import op11_hard_negatives
from ledgerlark.llm.licenses import op9_license_scan
from ledgerlark.llm.merkle import op12_merkle_manifest
from ledgerlark.llm.near_dedup import op1_near_duplicates
from ledgerlark.llm.packing import op8_pack_sequences
from ledgerlark.llm.pieces import op4_piece_ids
from ledgerlark.llm.pii import op7_pii_spans
from ledgerlark.llm.quality import op6_line_quality
from ledgerlark.llm.sharding import op2_balanced_shards
from ledgerlark.llm.token_counts import op10_token_counts
from ledgerlark.llm.token_index import op3_token_index

QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_balanced_shards, op3_token_index, op4_piece_ids, op5_fingerprints, op6_line_quality, op7_pii_spans, op8_pack_sequences, op9_license_scan, op10_token_counts, op11_hard_negatives, op12_merkle_manifest, op13_decontamination)}
ORACLES: dict[str, str] = {"op1_near_duplicates": near_dedup.ORACLE, "op6_line_quality": quality.ORACLE, "op9_license_scan": licenses.oracle_sql(), "op11_hard_negatives": hard_negatives.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_decontamination": decontamination.ORACLE}
