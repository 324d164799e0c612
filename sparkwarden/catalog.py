"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import inventory_queries, lua_queries, text_queries

QUERIES: dict = text_queries.QUERIES | inventory_queries.QUERIES | lua_queries.QUERIES
ORACLE_SQL: dict = text_queries.ORACLE_SQL | inventory_queries.ORACLE_SQL | lua_queries.ORACLE_SQL
FLAGSHIP = "q_report"
