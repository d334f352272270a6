"""Queries of the llm subpackage and, where SQL can say it, the statements beside them."""

from __future__ import annotations

from tidemark.llm import query_sets, query_texts

QUERIES = query_sets.QUERIES | query_texts.QUERIES
SQL = query_sets.SQL | query_texts.SQL
