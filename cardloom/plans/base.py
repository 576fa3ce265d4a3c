"""Registration of queries with their SQL."""

from __future__ import annotations

_Q: dict = {}
_SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict:
    return dict(_SQL)
