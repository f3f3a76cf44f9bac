"""Looking for a piece of a text costs the same however many values there are, and finds a value wherever it lies."""

import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import key_marks
from palisade.operators.occurrences import literal_occurrences

VALUE = "project_id string, value string"


def test_full_lists_of_marks_are_no_slower(spark, monkeypatch):
    values = spark.range(60_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("key-"), F.md5(F.col("id").cast("string"))).alias("value"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.md5(F.concat_ws("-", "id", i))), "")
    texts = spark.range(0, 8, 1, 8).select(F.lit("p").alias("project_id"), "id", F.concat(text, F.when(F.col("id") == 7, F.concat(F.lit(" key-"), F.md5(F.lit("7")))).otherwise("")).alias("text"))

    def seconds() -> float:
        found, began = literal_occurrences(texts, values, ["id"], broadcast=False, salts=1), time.monotonic()
        assert [(r.id, r.line) for r in found.collect()] == [(7, 1)]
        return time.monotonic() - began

    seconds()
    usual = min(seconds(), seconds())
    monkeypatch.setattr(key_marks, "LISTS", 4)  # as full as with a thousand times as many values
    full = seconds()
    assert full < 3 * usual + 1, (full, usual)


@pytest.mark.parametrize("size", [16, 20])
def test_a_value_is_found_at_every_place(spark, size):
    kinds = {"run": "k" + "0123456789abcdefghijklmnop"[:size - 1], "long": "x-" * 9 + "tail0123456789abcdefghijk", "words": "a note of 12345 for all here"[:size + 2], "wide": "ø€" * size}
    values = spark.createDataFrame([("p", v) for v in kinds.values()] + [(None, kinds["run"])], VALUE)
    rows = [("p", f"{k}/{n}/{after}", "é" * (n % 3) + "z" * n + v + after) for k, v in kinds.items() for n in range(30) for after in ("", "q", "\nmore text here")]
    rows += [("other", "foreign", kinds["run"]), (None, "none", kinds["run"]), ("p", "without its end", kinds["run"][:-1])]
    found = literal_occurrences(spark.createDataFrame(rows, "project_id string, id string, text string"), values, ["id"], size)
    assert sorted((r.id, r.value, r.line) for r in found.collect()) == sorted((i, v, 1) for p, i, t in rows for v in kinds.values() if p == "p" and v in t)


def test_marks_hold_every_key_and_few_others(spark):
    for n in (1, 3000, 100_000):
        keys = spark.range(n).select(key_marks.key_hash("id").alias("mark"))
        held = key_marks.key_marks(keys, "mark")
        count = lambda ids, held=held: ids.where(key_marks.may_hold(held, key_marks.key_hash("id"))).count()
        assert count(spark.range(n)) == n and count(spark.range(n, n + 50_000)) < 4000
