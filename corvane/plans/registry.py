"""All core queries by name."""

from __future__ import annotations

from corvane.operators import freshness, graph, hierarchy, history, references, reliability, search, store
from corvane.streaming import audit

_MODULES = (references, hierarchy, history, store, reliability, graph, freshness, search, audit)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
