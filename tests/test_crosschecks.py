"""A sample of the cross-checks at the smallest scale; ``python -m tools.crosscheck`` runs all of them."""

from glob import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from palisade.checks import all_checks
from tools.crosscheck import normal

SF = "/root/testdata/sf0.001"
SAMPLE = ("pf1_explode_lines", "rs2_scan_env_format", "rs1_hardcoded_secret", "jn1_hardcoded_env_values", "jn11_ignore_coverage",
          "rs4_commit_findings", "hd_all_header_findings", "ag6_datastore_list", "jn16_open_tables_first", "rs5_scan_text_secrets",
          "jn2_env_value_exposure", "st3_stream_exposure_dedup")


def test_every_query_has_its_sql():
    assert set(all_checks.SPARK) == set(all_checks.ORACLE) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    df = entry_point.queries()[name](spark, SF)
    cur = con.execute(entry_point.oracle_sql()[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([d[0] for d in cur.description], cur.fetchall())
