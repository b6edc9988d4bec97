"""The queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_engine.llm import bloom_dedup, byte_bpe, hard_negatives, language_mixture, mix_sources, packed_ids, positive_unlabelled, prefix_forest, prefix_trie, quartile_digest, secret_layers, simhash_tiles, virtual_slots

MODULES = (mix_sources, byte_bpe, virtual_slots, language_mixture, simhash_tiles, positive_unlabelled, secret_layers, quartile_digest, prefix_forest, packed_ids, bloom_dedup, prefix_trie, hard_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
