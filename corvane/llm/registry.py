"""All queries of this package by name."""

from __future__ import annotations

from corvane.llm import leakage, mixing, neardup, quality, runs

QUERIES = runs.QUERIES | neardup.QUERIES | leakage.QUERIES | mixing.QUERIES | quality.QUERIES
SQL = runs.SQL | neardup.SQL | leakage.SQL | mixing.SQL | quality.SQL
