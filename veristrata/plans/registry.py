"""All registered queries and their SQL, gathered from the query modules of this package.

Every query reads a whole table. ``CASES`` are the same operators over a few literal rows, for the tests.
"""

from __future__ import annotations

from . import bound, facts, findings, generated, judging, kept, language, ledgers, live, monthly, roles, search, stack, wording

_MODULES = (facts, search, ledgers, language, judging, wording, stack)
_LITERAL = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
_LITERAL_SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
QUERIES: dict = {k: q for k, q in _LITERAL.items() if k not in generated.QUERIES} | generated.QUERIES | bound.QUERIES | findings.QUERIES | live.QUERIES | monthly.QUERIES | kept.QUERIES | roles.QUERIES
SQL: dict[str, str] = {k: q for k, q in _LITERAL_SQL.items() if k not in generated.QUERIES} | generated.SQL | bound.SQL | findings.SQL | live.SQL | monthly.SQL | kept.SQL | roles.SQL
CASES: dict = {k: q for k, q in _LITERAL.items() if k in generated.QUERIES}
CASES_SQL: dict[str, str] = {k: q for k, q in _LITERAL_SQL.items() if k in generated.QUERIES}
