"""Registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, language_id, line_dedup, merkle, mixing, ngram_join, quality, secrets, sharding, substring_dedup, token_counts, whitening

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality": quality.op3_quality,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op5_sharding": sharding.op5_sharding,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": language_id.op10_language_id,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
