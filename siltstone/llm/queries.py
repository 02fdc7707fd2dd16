"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules in the order of their operators.
MODULES = ["chat_format", "decontaminate", "substring_dedup", "language_id", "bpe", "embedding_dedup", "html_text", "sharding", "minhash_dedup", "lm_score", "importance", "warc", "prefix_trie"]


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"siltstone.llm.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
