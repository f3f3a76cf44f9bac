"""Captured responses, browser traffic and access-probe logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAFFIC_SCHEMA = (
    "project_id string, request_id bigint, ts timestamp, method string, url string, resource_type string, "
    "request_headers map<string,string>, content_type string, body_bytes bigint, body string"
)


def header_map(headers: Column) -> Column:
    """Header names in lower case; of repeated names the last value counts."""
    return F.transform_keys(headers, lambda k, _: F.lower(k))


def parse_header_block(block: Column) -> Column:
    """``Name: value`` lines to a map of lower-case names."""
    pairs = F.transform(
        F.filter(F.split(block, "\n"), lambda l: F.instr(l, ":") > 0),
        lambda l: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))),
                           F.trim(F.substring(l, F.instr(l, ":") + 1, F.length(l)))),
    )
    return F.map_from_entries(pairs)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """One row per crawled URL: ``project_id, url, status, headers, body`` (SRC-5)."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return responses(reader.load(path))


def responses(raw: DataFrame) -> DataFrame:
    """Normalise captured responses; ``headers`` may be a map or a raw header block."""
    is_map = dict(raw.dtypes)["headers"].startswith("map")
    parsed = header_map(F.col("headers")) if is_map else parse_header_block(F.col("headers"))
    return raw.withColumn("headers", parsed)


def read_traffic(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
                 max_files: int | None = None) -> DataFrame:
    """Requests with their textual bodies, as a table or a stream of files (SRC-6)."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).schema(TRAFFIC_SCHEMA)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_access_probes(spark: SparkSession, path: str) -> DataFrame:
    """``project_id, table_name, key_var, combo, status, rows_returned`` (SRC-7)."""
    return spark.read.parquet(path).select(
        "project_id", "table_name", "key_var", "combo", "status", "rows_returned")
