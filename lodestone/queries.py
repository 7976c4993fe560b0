"""The engine's queries by name, and the DuckDB SQL with the same rows."""

from __future__ import annotations

from lodestone.plans import documents, envelope, retrieval, rules, segments, web

FLAGSHIP = "hybrid_retrieve"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (documents, retrieval, segments, web, rules, envelope):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
