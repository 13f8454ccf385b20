"""Where plans register their queries and the SQL that has the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planwright.sources.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), dealt: bool | str = False) -> Callable:
    """Registers f(v), where v(relation) is a DataFrame; `sql` continues the WITH clause of `views`. `dealt` is that of view()."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda relation: view(spark, sf_dir, relation, dealt))
        if sql is not None:
            ORACLE_SQL[name] = duck(*views) + sql if views else sql
        return f

    return add
