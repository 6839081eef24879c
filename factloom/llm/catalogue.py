"""All queries of the llm subpackage, by name."""

from __future__ import annotations

from factloom.llm.queries import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
