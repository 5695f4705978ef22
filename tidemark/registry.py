"""All queries by name, and the SQL that each is held against."""

from __future__ import annotations

from tidemark.plans import partitioning, preconditioned, rounds, routing, skew, sources, streams

PAIRS = skew.PAIRS | rounds.PAIRS | routing.PAIRS | partitioning.PAIRS | preconditioned.PAIRS | streams.PAIRS | sources.PAIRS
QUERIES = {name: query for name, (query, _) in PAIRS.items()}
SQL = {name: sql for name, (_, sql) in PAIRS.items() if sql}
