"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locuskit.plans.views import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function under its name; `sql` follows the views' WITH clause (or stands alone)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (SQL + sql if sql.lstrip().split()[1:2] == ["AS"] else SQL.rstrip().rstrip(",") + "\n" + sql) if views else sql
        return f

    return add
