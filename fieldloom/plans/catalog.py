"""The registered queries of the library and their SQL twins."""

from __future__ import annotations

from fieldloom.plans import checks, fields, flow, headers, pages, reading, records, scalars, small, voting

_MODULES = (voting, scalars, records, reading, checks, fields, pages, flow, headers, small)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
