"""The subpackage's registered queries and their oracle SQL."""

from __future__ import annotations

from bizlens.llm import (
    bpe,
    decontaminate,
    jaccard,
    language,
    lines,
    manifest,
    pii,
    quality,
    resample,
    secret_scan,
    suffixes,
    token_counts,
    urls,
)

QUERIES = {
    "op1_url_filters": urls.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_jaccard_join": jaccard.op3,
    "op4_quality_rules": quality.op4,
    "op5_line_dedup": lines.op5,
    "op6_token_counts": token_counts.op6,
    "op7_language_id": language.op7,
    "op8_suffix_dedup": suffixes.op8,
    "op9_pii": pii.op9,
    "op10_bpe": bpe.op10,
    "op11_secret_scan": secret_scan.op11,
    "op12_importance_resampling": resample.op12,
    "op13_merkle_manifest": manifest.op13,
}

ORACLE = {
    "op1_url_filters": urls.OP1_SQL,
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op11_secret_scan": secret_scan.OP11_SQL,
    "op12_importance_resampling": resample.OP12_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
