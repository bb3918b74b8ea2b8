"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, embedding_dedup, filter_audit, language_id, license_scan, line_dedup, manifest, mixing, near_dedup, nearest, substring_dedup, token_counts, token_store

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_token_store": token_store.op6_token_store,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "line_dedup_passages": line_dedup.line_dedup_passages,
    "op9_nearest": nearest.op9_nearest,
    "op10_language_id": language_id.op10_language_id,
    "op11_manifest": manifest.op11_manifest,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_decontaminate": decontaminate.OP1_SQL, "op2_license_scan": license_scan.OP2_SQL, "op5_mix_sources": mixing.OP5_SQL, "op7_near_dedup": near_dedup.OP7_SQL, "op8_line_dedup": line_dedup.OP8_SQL, "line_dedup_passages": line_dedup.LINE_DEDUP_PASSAGES_SQL, "op11_manifest": manifest.OP11_SQL, "op12_embedding_dedup": embedding_dedup.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
