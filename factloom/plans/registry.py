"""How the modules of this package name their queries."""

from __future__ import annotations


class Registry:
    """A decorator that keeps queries by name, with the same in DuckDB's SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add
