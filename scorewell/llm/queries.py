"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from scorewell.llm import (
    best_fit,
    exact_dedup,
    filter_audit,
    minhash,
    packing,
    pieces,
    pii,
    quality,
    resampling,
    secrets,
    sharding,
    toxicity,
    urls,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_secrets": secrets.op3_secrets,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_minhash": minhash.op5_minhash,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_url_filter": urls.op8_url_filter,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_best_fit": best_fit.op11_best_fit,
    "op12_resampling": resampling.op12_resampling,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op7_exact_dedup": exact_dedup.SQL.strip(),
    "op8_url_filter": urls.SQL.strip(),
    "op13_filter_audit": filter_audit.SQL.strip(),
}
