"""All core queries by name, with their SQL. The queries live in the modules imported here; each registers a function
(spark, sf_dir) -> DataFrame under its name, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from tidemark.plans import q_analytics, q_buckets, q_graph, q_resolve, q_retrieval, q_sessions, q_store
from tidemark.plans.registry import QUERIES, SQL

MODULES = (q_analytics, q_buckets, q_graph, q_resolve, q_retrieval, q_sessions, q_store)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
