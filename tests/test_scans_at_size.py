"""Scans run once, and in tasks of an even size."""

from pyspark.sql import functions as F

from palisade.operators.code_scan import stack_gate
from palisade.session import SPLIT_BYTES, SPLIT_KEY, prepare
from palisade.sources.shared import write_once


def test_stack_gate_finds_hits_once(spark):
    schema = "project_id string, file string, line int, stack string"
    hits = spark.createDataFrame([("p", "a", 1, None), ("p", "a", 2, "x"), ("p", "a", 2, "x"), ("p", "b", 3, "y"), ("q", "a", 1, "x"), (None, "a", 1, None), (None, "a", 1, "x")], schema)
    stacks = spark.createDataFrame([("p", "x"), ("p", "x"), (None, "x"), ("p", None), ("q", "y")], "project_id string, stack string")
    looked = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    kept = stack_gate(hits.mapInArrow(look, schema), stacks).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [("p", "a", 1, None), ("p", "a", 2, "x"), ("p", "a", 2, "x"), (None, "a", 1, None)]))
    assert looked.value == 7


def test_files_are_read_in_small_splits(spark):
    before = spark.conf.get(SPLIT_KEY)
    try:
        spark.conf.set(SPLIT_KEY, "128MB")
        assert prepare(spark).conf.get(SPLIT_KEY) == str(SPLIT_BYTES)
        spark.conf.set(SPLIT_KEY, "5m")
        assert prepare(spark).conf.get(SPLIT_KEY) == "5m"
        spark.conf.set(SPLIT_KEY, "16m")
        wide = spark.range(0, 600_000, 1, 1).select("id", F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.col("id").cast("string"), 384)).alias("text"))
        written = write_once(wide, "wide")
        sizes = written.groupBy(F.spark_partition_id()).count().where("count > 0").collect()
        assert len(sizes) > 1 and written.count() == 600_000
    finally:
        spark.conf.set(SPLIT_KEY, before)
