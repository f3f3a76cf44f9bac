"""The grid of a large project is worked out by all tasks, and is the whole product."""

from collections import Counter

from pyspark.sql import functions as F

from palisade.operators.probes import probe_grid
from palisade.rules.datastores import AUTH_COMBOS

KEYS = "project_id string, var string, token string, role string, is_jwt boolean"


def test_one_project_is_no_task_of_its_own(spark):
    keys = spark.range(0, 1100, 1, 1).selectExpr("'p' AS project_id", "concat('K', id % 7) AS var", "concat('t', id) AS token", "'anon' AS role", "false AS is_jwt")
    tables = spark.range(0, 90, 1, 1).selectExpr("'p' AS project_id", "concat('t', id) AS table_name")
    sizes = [r["count"] for r in probe_grid(keys, tables).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1100 * 90 * len(AUTH_COMBOS) and max(sizes) < sum(sizes) / 3


def test_every_key_meets_every_table_of_its_project(spark):
    rows = [("p", f"K{i % 3}", f"t{i}", "anon", i % 2 == 0) for i in range(700)] + [("p", "K", "twice", "anon", True)] * 2
    rows += [("q", None, "t", None, None), ("q", "K", "t", "service_role", True), ("only keys", "K", "t", "anon", True), (None, "K", "t", "anon", True)]
    names = [("p", f"t{i}") for i in range(40)] + [("q", "a"), ("q", "a"), ("q", None), ("only tables", "a"), (None, "a")]
    found = probe_grid(spark.createDataFrame(rows, KEYS), spark.createDataFrame(names, "project_id string, table_name string"), salts=3)
    wanted = Counter((p, v, r, j, t, i, c) for p, v, _, r, j in rows for q, t in names if p == q and p is not None for i, c in enumerate(AUTH_COMBOS))
    assert Counter(map(tuple, found.collect())) == wanted
