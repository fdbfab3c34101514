"""Every operator run over the driver tables, each with SQL for the same result."""

from __future__ import annotations

from recordloom.queries import codestats, files, intervals, ledger, preview, sheet

_AREAS = (ledger, intervals, codestats, sheet, preview, files)


def all_queries() -> dict:
    return {name: query for area in _AREAS for name, query in area.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.SQL.items()}
