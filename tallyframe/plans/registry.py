"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import q_analytics, q_records, q_relational, q_shapes

QUERIES: dict = {**q_relational.QUERIES, **q_analytics.QUERIES, **q_records.QUERIES, **q_shapes.QUERIES}
ORACLE_SQL: dict[str, str] = {**q_relational.ORACLE_SQL, **q_analytics.ORACLE_SQL, **q_records.ORACLE_SQL, **q_shapes.ORACLE_SQL}
