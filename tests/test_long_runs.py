"""The coefficient of a run that leaves the range of doubles."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.streaming import jobs

ROWS = [(1, i, 0.5 if i % 50 else 0.0, 90 if i % 50 else 600) for i in range(1, 6001)] + [(2, 1, 0.1, 8), (3, 1, 0.08, 500), (3, 2, 0.5, 8)]


def _want():
    out, logs, sign = {}, [math.log(0.2)], 1
    for run, i, kl, n in ROWS[:6000]:
        f = 1 + min(max(kl / 0.1 - 1, -0.2), 0.2) * n / 100
        logs.append(math.log(abs(f)))
        sign = -sign if f < 0 else sign
        out[i] = (sign, math.fsum(logs))
    return out


def test_sign_and_logarithm_outlast_the_double(spark):
    df = spark.createDataFrame(ROWS, "run long, step long, kl double, n long").repartition(3)
    got = {(r.run, r.step): r for r in jobs.adaptive_kl(df, "run", "step", "kl", "n", 0.2, 0.1, 100.0).collect()}
    want = _want()
    assert want[6000][1] > 710 and math.isinf(abs(got[1, 6000].beta))
    assert all(got[1, i].sign == s and abs(got[1, i].log_beta - x) < 1e-11 for i, (s, x) in want.items())
    assert got[2, 1].beta == pytest.approx(0.2)
    # a factor of zero ends the run
    assert (got[3, 1].beta, got[3, 1].sign, got[3, 2].beta, got[3, 2].log_beta) == (0.0, 0, 0.0, float("-inf"))


def test_batches_go_on_beyond_the_double(spark, tmp_path):
    feed, out, mark = (str(tmp_path / n) for n in ("feed", "out", "mark"))
    schema = "run long, step long, kl double, n long"
    for part in (ROWS[:5500], ROWS[5500:6000], ROWS[6000:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        jobs.stream_adaptive_kl(spark.readStream.schema(schema).parquet(feed), "run", "step", "kl", "n", out, mark, 0.2, 0.1, 100.0)
    got = {r.step: (r.sign, r.log_beta) for r in spark.read.parquet(out).filter(F.col("run") == 1).collect()}
    want = _want()
    assert all(got[i][0] == s and abs(got[i][1] - x) < 1e-9 for i, (s, x) in want.items())
