"""Scorers that may wait are not left to the one task of a small file."""

import pytest

import __spark_entry__ as entry
from weftline.session import spread_waits


@pytest.mark.parametrize("name", ["scorer_with_timeout", "scorer_limits"])
def test_rows_with_time_limits_are_dealt_out(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_waits_are_evened_out_by_many_tasks(spark):
    """Rows of one key do not meet in one task, and there are several tasks for a core."""
    df = spark.createDataFrame([(1, 1, f"r{i}") for i in range(400)], "conv_id long, turn long, t string").coalesce(1)
    made = spread_waits(df).rdd.glom().map(len).collect()
    assert sum(made) == 400 and len(made) >= 8 * spark.sparkContext.defaultParallelism and max(made) <= 2 * 400 / len(made) + 1
