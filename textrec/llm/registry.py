"""The list of this subpackage's queries."""

from __future__ import annotations

from textrec.queries.registry import Query

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def register(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register
