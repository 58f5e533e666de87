"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from corpusieve.queries import documents, events, pages, scores, vectors

MODULES = (documents, scores, vectors, pages, events)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
