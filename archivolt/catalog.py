"""Every registered query of the engine with its SQL."""

from __future__ import annotations

from archivolt.queries import analytics, attachments, cases, clusters, conditions, corpus, discover, fulltext, further, grouping, groups, imports, incremental, ingest, model, origins, relational, selections, signals, structure, suggestions, texts, threads, values
from archivolt.registry import Query, Registry

_GROUPS: tuple[Registry, ...] = tuple(m.registry for m in (conditions, values, relational, grouping, groups, texts, signals, model, cases, corpus, analytics, ingest, imports, selections, further, fulltext, structure, incremental, attachments, threads, clusters, origins, discover, suggestions))


def queries() -> dict[str, Query]:
    return {name: query for group in _GROUPS for name, query in group.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.oracles.items()}
