"""All queries by name, with SQL that says the same for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from . import composites, joins, questions, soc, wider, wider_sql
from .dialects import register_sql

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for _pack in (soc.PACK, joins.PACK, questions.PACK, questions.LOAD, wider_sql.PACK):
    register_sql(QUERIES, ORACLE_SQL, _pack)
QUERIES |= composites.QUERIES | wider.QUERIES
ORACLE_SQL |= composites.ORACLE_SQL | wider.ORACLE_SQL
