"""Registered queries over the driver's tables and their SQL for DuckDB, by name."""

from lectern.queries import audio, cast, pages, script, texts

_MODULES = (texts, pages, script, cast, audio)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
