"""Positions, running totals and carried values, with a group that spans partitions."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import index as ix


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(3)
    rows = [(("hot" if i % 3 == 0 else f"k{i % 7}"), i, rnd.randrange(10)) for i in range(600)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "g string, o long, v long").repartition(4)


def test_row_index_counts_from_zero(hot):
    got = {r.o: r.row_idx for r in ix.with_row_index(hot, ["o"]).collect()}
    assert got == {i: i for i in range(600)}


def test_row_index_of_an_empty_table(spark):
    assert ix.with_row_index(spark.range(0), ["id"]).count() == 0


def test_group_index_of_a_hot_group(hot):
    rows = hot.collect()
    want = {r.o: sum(x.g == r.g and x.o < r.o for x in rows) for r in rows}
    got = ix.with_group_index(hot, ["g"], [F.col("o")], "i").collect()
    assert {r.o: r.i for r in got} == want


def test_group_totals_of_a_hot_group(hot):
    rows = hot.collect()
    want = {r.o: sum(x.v for x in rows if x.g == r.g and x.o < r.o) for r in rows}
    got = ix.with_group_totals(hot, ["g"], [F.col("o")], {"s": F.col("v")}).collect()
    assert {r.o: r.s for r in got} == want


def test_totals_of_doubles_never_mix_with_other_groups(spark):
    rows = [("a", i, 1e16) for i in range(5)] + [("b", i, 0.1) for i in range(5)] + [(None, i, 0.5) for i in range(3)]
    got = {(r.g, r.o): r.s for r in ix.with_group_totals(spark.createDataFrame(rows, "g string, o long, v double"), ["g"], [F.col("o")], {"s": F.col("v")}, kind="double").collect()}
    assert [got["b", i] for i in range(5)] == pytest.approx([0, 0.1, 0.2, 0.3, 0.4], abs=1e-12)
    assert [got[None, i] for i in range(3)] == [0, 0.5, 1.0]


def test_last_before_carries_over_partitions(hot):
    rows = hot.collect()

    def last(r):
        seen = [x for x in rows if x.g == r.g and x.o < r.o and x.v == 7]
        return max(seen, key=lambda x: x.o).o if seen else None
    got = ix.with_last_before(hot, ["g"], ["o"], F.col("v") == 7, F.col("o"), "prev").collect()
    assert {r.o: r.prev for r in got} == {r.o: last(r) for r in rows}


def test_exact_quantile_interpolates(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert ix.exact_quantile(df, "x", 0.5) == 2.5
    assert ix.exact_quantile(df, "x", 1.0) == 4.0
    assert ix.exact_quantile(df.limit(0), "x", 0.5) is None


def test_null_keys_join(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v long")
    got = ix.attach_group(df, ["k"], F.sum("v").alias("s")).collect()
    assert sorted((r.v, r.s) for r in got) == [(1, 3), (2, 3), (3, 3)]
