"""The registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(job: Callable[[SparkSession, str], DataFrame]):
        SPARK[name] = job
        if sql is not None:
            ORACLE[name] = sql
        return job
    return register
