"""The queries of the core operators, {name: function(spark, dir)}, and the SQL that says the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return put
