"""Registered queries of the library and the SQL that each must equal."""

from __future__ import annotations

from . import annotation, composites, reports, retrieval, scoring, sources, team, text, timeline

_MODULES = (retrieval, text, timeline, scoring, team, composites, annotation, reports, sources)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
