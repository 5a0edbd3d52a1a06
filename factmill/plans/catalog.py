"""Registers a query with its DuckDB equivalent."""

from __future__ import annotations


class Catalog:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(query):
            self.queries[name] = query
            if sql:
                self.oracle[name] = sql
            return query

        return add
