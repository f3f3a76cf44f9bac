"""The derived inputs are built by all cores."""

from palisade.checks.fixtures import Inputs


def test_projects_are_spread_before_they_are_multiplied(spark):
    probes = Inputs(spark, "/root/testdata/sf0.01").derive("fx_probes")
    filled = [n for n in probes.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(filled) == probes.count() and len(filled) >= 6 and max(filled) < sum(filled) / 3
