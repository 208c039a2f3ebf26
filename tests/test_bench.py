"""The benchmark's workloads can be planned."""

import bench

SMALL = "/root/testdata/sf0.001"


def test_workloads_plan(spark):
    assert [len(bench.WORK[name](spark, SMALL).columns) > 1 for name in ("operators_20", "asof_augment", "quarterly_validation")] == [True] * 3
