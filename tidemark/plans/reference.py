"""Queries of the engine's own operators over the given tables, with the SQL beside each."""

from __future__ import annotations

from tidemark.plans import ref_advice, ref_boards, ref_camps, ref_cards, ref_eras, ref_families, ref_labels, ref_matches, ref_multi, ref_pooling, ref_ranking, ref_tuning

_PARTS = (ref_matches, ref_cards, ref_advice, ref_labels, ref_pooling, ref_families, ref_eras, ref_multi, ref_ranking, ref_camps, ref_boards, ref_tuning)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
