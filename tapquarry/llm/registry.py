"""Queries of the training-data operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import op1_html, op2_mixing, op3_suffix_dedup, op4_weighted_sampling, op5_decontaminate, op6_sharding, op7_debruijn_dedup, op8_token_shards, op9_toxicity, op10_minhash

QUERIES = {
    "op1_html": op1_html.query,
    "op2_mixing": op2_mixing.query,
    "op3_suffix_dedup": op3_suffix_dedup.query,
    "op4_weighted_sampling": op4_weighted_sampling.query,
    "op5_decontaminate": op5_decontaminate.query,
    "op6_sharding": op6_sharding.query,
    "op7_debruijn_dedup": op7_debruijn_dedup.query,
    "op8_token_shards": op8_token_shards.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_minhash": op10_minhash.query,
}
ORACLES: dict[str, str] = {
    "op2_mixing": op2_mixing.ORACLE,
    "op6_sharding": op6_sharding.ORACLE,
}
