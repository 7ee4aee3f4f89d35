"""Registers a query beside the SQL it is checked against."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracle: dict = {}

    def query(name: str, sql: str | None = None):
        def add(call):
            queries[name] = call
            if sql is not None:
                oracle[name] = sql
            return call

        return add

    return queries, oracle, query
