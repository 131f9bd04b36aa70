"""All registered queries."""

from __future__ import annotations

from logloom.plans import (
    log_queries,
    match_queries,
    model_queries,
    parse_queries,
    report_queries,
    session_queries,
    source_queries,
)

_MODULES = (
    session_queries,
    log_queries,
    report_queries,
    match_queries,
    parse_queries,
    model_queries,
    source_queries,
)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
