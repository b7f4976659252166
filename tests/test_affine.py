"""Linear recurrences by affine maps against plain loops and the array form."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import affine, tokens as tk


@pytest.mark.parametrize("rows", [3, 64])
def test_entering_values(spark, rows):
    """One group holds most rows; factors of zero and of either sign; small blocks need several levels."""
    rnd = random.Random(rows)
    sizes = {None: 3, 1: 700, 2: 1, 3: 65, 4: 64}
    made = [(k, t, rnd.choice([0.0, -0.9, 0.5, 0.95, 1.0]), rnd.uniform(-2, 2)) for k, n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(rnd.sample(made, len(made)), "k long, t long, a double, b double").repartition(5)
    got = {(r.k, r.t): r.x for r in affine.with_entering(df, ["k"], [F.col("t").desc()], F.col("a"), F.col("b"), "x", rows).collect()}
    assert len(got) == len(made)
    at = {(k, t): (a, b) for k, t, a, b in made}
    for k, n in sizes.items():
        x = 0.0
        for t in reversed(range(n)):
            assert got[k, t] == pytest.approx(x, abs=1e-9)
            a, b = at[k, t]
            x = a * x + b
    assert affine.with_entering(df.limit(0), ["k"], ["t"], F.col("a"), F.col("b"), "x").count() == 0


def test_token_rows_equal_the_array_form(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(9):
        n = rnd.choice([1, 7, 130])
        ones = rnd.randrange(1, n + 1)
        rows.append((i, [rnd.uniform(-1, 1) for _ in range(n)], [rnd.uniform(-1, 1) for _ in range(n)], [1] * ones + [0] * (n - ones)))
    df = spark.createDataFrame(rows, "id long, r array<double>, v array<double>, m array<int>")
    long = tk.explode_tokens(df, ["id"], r="r", v="v", m="m")
    pairs = [(tk.gae(df, "r", "v", "m", 0.99, 0.95), affine.gae_rows(long, ["id"], "t", "r", "v", "m", 0.99, 0.95)),
             (tk.reinforce_pp(df, "r", "m", 0.9), affine.reinforce_pp_rows(long, ["id"], "t", "r", "m", 0.9))]
    for arrays, tokens in pairs:
        want = {(r.id, t): (a, x) for r in arrays.collect() for t, (a, x) in enumerate(zip(r.advantages, r.returns))}
        got = {(r.id, r.t): (r.advantages, r.returns) for r in tokens.collect()}
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)
        assert "Python" not in tokens._jdf.queryExecution().executedPlan().toString()
