"""Registered queries over the driver's tables, each with SQL of the same rows where SQL can say it."""

from __future__ import annotations

from quillgraph.queries import graphs, more, tables

QUERIES = {**tables.QUERIES, **graphs.QUERIES, **more.QUERIES}
ORACLE_SQL = {**tables.ORACLE_SQL, **graphs.ORACLE_SQL, **more.ORACLE_SQL}
