"""All queries of the engine and their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import consistency, documents, relational, semantics, series, upkeep, writes

_ALL = documents.Q | series.Q | consistency.Q | relational.Q | upkeep.Q | writes.Q | semantics.Q

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: text for name, (_, text) in _ALL.items() if text}
