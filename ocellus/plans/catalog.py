"""Registry of the named queries and their reference SQL."""

from __future__ import annotations

from ocellus.plans import perception, tracking

QUERIES: dict = {**perception.QUERIES, **tracking.QUERIES}
ORACLE_SQL: dict[str, str] = {**perception.ORACLE_SQL, **tracking.ORACLE_SQL}
