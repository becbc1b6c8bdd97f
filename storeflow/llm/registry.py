"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from storeflow.llm import (
    bpe, byte_dedup, clustering, conversation_trie, decontamination, fingerprints, language_model, lines, near, quality,
    url_filter, vector_search, word_dedup,
)
from storeflow.llm.tables import Query

MODULES = (
    bpe, vector_search, language_model, lines, near, url_filter, byte_dedup, word_dedup, decontamination, quality,
    conversation_trie, clustering, fingerprints,
)


def load() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in MODULES:
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
