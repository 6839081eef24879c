"""All queries of the core, by name."""

from __future__ import annotations

from factloom.plans import classification, core_problems, events, extraction, more, network, people, reference, verification

MODULES = (core_problems, reference, extraction, verification, network, classification, events, people, more)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
