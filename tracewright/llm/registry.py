"""The registered queries of this subpackage: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from tracewright.llm import chat, decontaminate, embedding_dedup, html_text, mixing, near_duplicates, pii, quality, search, sharding, spelling, substring_dedup, suffix_dedup

MODULES = (pii, quality, decontaminate, near_duplicates, mixing, html_text, suffix_dedup, embedding_dedup, chat, substring_dedup, search, spelling, sharding)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
