"""The registry of queries: each operator on views of the given tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans.bindings import view, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, more: tuple[str, ...] = ()):
    """Registers a function of views. ``sql`` may begin with further named parts, ``x AS (...), y AS (...) SELECT ...``."""

    def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(*(view(spark, sf_dir, v) for v in views))
        if sql:
            given = with_clause((*views, *more))
            named = sql.lstrip().split(" ", 2)[1] == "AS"
            ORACLE_SQL[name] = f"{given}, {sql}" if given and named else f"{given} {sql}" if given else f"WITH RECURSIVE {sql}" if named else sql
        return make

    return add
