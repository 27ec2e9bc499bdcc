"""All queries on the reference's operators, each with its SQL."""

from __future__ import annotations

from rillmill.plans import alarm, dataflow, graphs, joining, reports, routing, text, windows

_MODULES = (alarm, routing, joining, windows, text, graphs, dataflow, reports)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
