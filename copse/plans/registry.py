"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from copse.plans import ensembles, learn

QUERIES: dict = learn.QUERIES | ensembles.QUERIES
ORACLE_SQL: dict = learn.ORACLE_SQL | ensembles.ORACLE_SQL
