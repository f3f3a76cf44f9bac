"""Headline queries: one warm-up, then the median of three runs each; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8),
``BENCH_QUERIES`` a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from palisade.checks import all_checks
from palisade.checks.fixtures import Inputs
from palisade.operators.env_scan import explode_lines
from palisade.rules.code import CODE_RULES
from palisade.session import local_session
from palisade.sources.files import select_files

HEADLINE = (
    "fleet_corpus_scorecard", "rs7_corpus_documents", "rs1_scan_code_lines", "rs1_hardcoded_secret", "pf7_env_context_severity",
    "jn1_hardcoded_env_values", "jn1_hardcoded_env_values_salted", "jn11_ignore_coverage", "rs4_commit_findings",
    "hd_all_header_findings", "fl2_posture_summary", "ag5_datastore_profile", "jn16_open_tables_first",
    "rs5_scan_text_secrets", "jn2_env_value_exposure", "wd10_exposure_dedup", "tk1_top_api_calls", "st1_stream_secret_scan",
)
RUNS = 3


def run(job, spark, sf_dir) -> float:
    start = time.perf_counter()
    job(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    spark = local_session(cpus)
    seconds = {}
    for name in wanted:
        job = all_checks.SPARK[name]
        run(job, spark, sf_dir)
        seconds[name] = round(statistics.median(run(job, spark, sf_dir) for _ in range(RUNS)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rates = {}
    inputs = Inputs(spark, sf_dir)
    if "rs1_scan_code_lines" in seconds:
        lines = explode_lines(select_files(inputs.files, "code")).count()
        rates["rules_x_lines_per_sec"] = round(lines * len(CODE_RULES) / seconds["rs1_scan_code_lines"])
    if "st1_stream_secret_scan" in seconds:
        rates["stream_rows_per_sec"] = round(inputs.traffic.count() / seconds["st1_stream_secret_scan"])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rates": rates, "cpus": cpus, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
