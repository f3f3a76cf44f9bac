"""The list of cross-checked queries: a Spark job and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.checks.fixtures import Inputs

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register ``job(inputs)`` under a name, with its SQL if it has one."""
    def register(job: Callable[[Inputs], DataFrame]):
        SPARK[name] = lambda spark, sf_dir: job(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return job
    return register
