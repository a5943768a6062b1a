"""Queries of this folder and their SQL, by name."""

from __future__ import annotations

from . import chat, contamination, jaccard, langid, neighbours, packing, pii, quality, repair, toxicity

_MODULES = (repair, toxicity, chat, quality, langid, packing, pii, jaccard, neighbours, contamination)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
