"""The findings table every scan returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("scanner", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("header", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("env_var", T.StringType()),
    T.StructField("env_source", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("key_var", T.StringType()),
    T.StructField("key_role", T.StringType()),
    T.StructField("auth_combo", T.StringType()),
    T.StructField("rows_returned", T.IntegerType()),
    T.StructField("env_file", T.BooleanType()),
    T.StructField("dynamic_match", T.BooleanType()),
])


def as_findings(df: DataFrame, scanner: str | None = None) -> DataFrame:
    """Bring a scan's own columns into the common shape; absent ones become null."""
    if scanner is not None:
        df = df.withColumn("scanner", F.lit(scanner))
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FINDINGS.fields
    ])
