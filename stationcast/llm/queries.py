"""Loads every module that registers a query."""

from __future__ import annotations

from . import (  # noqa: F401
    collocations, conversation_trie, embedding_dedup, main_text, ngram_join, quality_rules, rule_ensemble,
    secret_scan, sentencepiece_codec, source_mix, substring_dedup, token_counts, url_filter,
)
from .registry import ORACLE, QUERIES  # noqa: F401
