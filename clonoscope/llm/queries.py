"""The queries opN_* over whole tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, language_id, line_dedup, mixing, near_dedup, neighbours, suffix_dedup, token_counts, toxicity
from .common import table

QUERIES = {
    "op1_suffix_dedup": lambda spark, sf_dir: suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")),
    "op2_byte_bpe": lambda spark, sf_dir: byte_bpe.round_trip(table(spark, sf_dir, "documents")),
    "op3_neighbours": lambda spark, sf_dir: neighbours.neighbours(table(spark, sf_dir, "embeddings")),
    "op4_toxicity": lambda spark, sf_dir: toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(table(spark, sf_dir, "documents")),
    "op6_language_id": lambda spark, sf_dir: language_id.language_id(table(spark, sf_dir, "documents")),
    "op7_line_dedup": lambda spark, sf_dir: line_dedup.line_dedup(table(spark, sf_dir, "documents")),
    "op8_near_dedup": lambda spark, sf_dir: near_dedup.near_dedup(table(spark, sf_dir, "documents")),
    "op9_token_counts": lambda spark, sf_dir: token_counts.token_counts(table(spark, sf_dir, "documents")),
    "op10_mixing": lambda spark, sf_dir: mixing.mix(table(spark, sf_dir, "documents")),
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
