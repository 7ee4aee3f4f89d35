"""All queries outside the llm subpackage, by name, with their SQL."""

from __future__ import annotations

from tidewatch.plans import analytics, asof, core, decisions, features, ingest, modelling, serving, streams

_MODULES = (core, asof, analytics, decisions, features, ingest, modelling, serving, streams)


def queries() -> dict:
    return {name: call for module in _MODULES for name, call in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}


def flagship(spark, sf_dir):
    """The most urgent entities at the as-of date, from what was known by then."""
    return decisions.attention_list(spark, sf_dir)
