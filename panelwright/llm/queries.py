"""Registered queries of the subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import q_context_tree, q_conversations, q_decontaminate, q_html_text, q_language_mix, q_mixing, q_near_dup, q_pii, q_quality, q_sharding, q_spelling, q_token_store, q_url_rules

_MODULES = (q_sharding, q_near_dup, q_context_tree, q_token_store, q_mixing, q_url_rules, q_language_mix, q_quality, q_decontaminate, q_html_text, q_spelling, q_pii, q_conversations)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
