"""The registered queries, by subject."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text_queries", "report_queries", "url_queries", "message_queries", "risk_queries", "intake_queries", "model_queries", "source_queries"]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in import_module(f"sentrail.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"sentrail.plans.{m}").ORACLE_SQL.items()}
