"""Queries of this subpackage and the SQL that they are held against, by name."""

from __future__ import annotations

from . import (
    bpe_transducer,
    cotraining,
    dart_minhash,
    extendible_shards,
    fuzzy_lines,
    length_buckets,
    order_minhash,
    robust_rules,
    secret_spans,
    suffix_dedup,
)

QUERIES = {
    "op1_cotraining": cotraining.query,
    "op2_order_minhash": order_minhash.query,
    "op3_robust_rules": robust_rules.query,
    "op4_bpe_transducer": bpe_transducer.query,
    "op5_length_buckets": length_buckets.query,
    "op6_extendible_shards": extendible_shards.query,
    "op7_fuzzy_lines": fuzzy_lines.query,
    "op8_secret_spans": secret_spans.query,
    "op9_dart_minhash": dart_minhash.query,
    "op10_suffix_dedup": suffix_dedup.query,
}

ORACLES = {
    "op6_extendible_shards": extendible_shards.ORACLE,
}
