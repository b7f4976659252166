"""Queries that run a stream over files of the given tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.index import with_row_index
from ..session import fresh_path, stage
from ..streaming import jobs
from .registry import joined, query, r6

PARTS = 4


def _feed(t, df: DataFrame, order: list, run) -> None:
    """Append the rows in four ordered parts and run the job after each.

    Every run is a restart on the same checkpoint that picks up the files of
    one part.
    """
    path = fresh_path(t.spark, "feed")
    placed = stage(with_row_index(df, order, "_i"), "ordered")
    n = placed.count()
    for i in range(PARTS):
        part = placed.filter((F.col("_i") * PARTS >= i * n) & (F.col("_i") * PARTS < (i + 1) * n)).drop("_i")
        part.write.mode("append").parquet(path)
        run(t.spark.readStream.schema(df.schema).parquet(path))


def _steps(t) -> DataFrame:
    return t.events.select("event_id", (F.col("user_id") % 5).alias("run"), F.col("user_id").alias("prompt"), (F.col("value") / 100).alias("kl"),
                           F.col("value").cast("int").alias("resp_len"), F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("score"))


S = "steps AS (SELECT event_id, user_id % 5 AS run, user_id AS prompt, value / 100 AS kl, trunc(value)::INT AS resp_len, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events)"


@query("stream_totals", f"""WITH {S} SELECT run, count(*) AS total_train_samples, sum(resp_len)::BIGINT AS total_train_tokens, sum(resp_len * score) AS total_train_correct_tokens,
 sum(resp_len * (1 - score)) AS total_train_incorrect_tokens, sum(score) AS total_train_correct_responses, sum(1 - score) AS total_train_incorrect_responses FROM steps GROUP BY run""")
def _(t):
    out = fresh_path(t.spark, "totals")
    mark = fresh_path(t.spark, "checkpoint")
    _feed(t, _steps(t), ["event_id"], lambda s: jobs.stream_totals(s, "run", "score", "resp_len", out, mark))
    every = t.spark.read.parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == last).drop("batch")


@query("stream_unique_prompts", f"WITH {S} SELECT DISTINCT prompt, run FROM steps")
def _(t):
    out = fresh_path(t.spark, "prompts")
    mark = fresh_path(t.spark, "checkpoint")
    _feed(t, _steps(t), ["event_id"], lambda s: jobs.stream_unique_prompts(s, "prompt", out, mark))
    return t.spark.read.parquet(out).select("prompt", "run")


# steps of 600 rows at horizon 100 are beyond 5 x horizon: a low KL then turns the sign
BETA = f"""WITH {S}, f AS (SELECT run, event_id, 1 + least(greatest(kl / 0.1 - 1, -0.2), 0.2) * (CASE WHEN event_id % 50 = 0 THEN 600 ELSE 8 END) / 100.0::DOUBLE AS f FROM steps)
SELECT run, event_id AS step, CASE WHEN (count(*) FILTER (f < 0) OVER w) % 2 = 1 THEN -1 ELSE 1 END AS sign, round(ln(0.2::DOUBLE) + sum(ln(abs(f))) OVER w, 6) + 0.0 AS log_beta FROM f WINDOW w AS (PARTITION BY run ORDER BY event_id)"""


def _sized(t):
    return _steps(t).withColumn("n", F.when(F.col("event_id") % 50 == 0, 600).otherwise(8))


def _told(df, step):
    return df.select("run", F.col(step).alias("step"), "sign", r6(F.col("log_beta")).alias("log_beta"))


@query("stream_adaptive_kl", BETA)
def _(t):
    out = fresh_path(t.spark, "beta")
    mark = fresh_path(t.spark, "checkpoint")
    _feed(t, _sized(t), ["event_id"],
          lambda s: jobs.stream_adaptive_kl(s, "run", "event_id", "kl", "n", out, mark, 0.2, 0.1, 100.0))
    return _told(t.spark.read.parquet(out), "step")


@query("adaptive_kl", BETA)
def _(t):
    return _told(jobs.adaptive_kl(_sized(t), "run", "event_id", "kl", "n", 0.2, 0.1, 100.0), "event_id")


BUFFER = f"""WITH {S}, ok AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM steps WHERE score = 0)
SELECT run, i // 32 AS step, event_id AS key FROM ok WHERE i < n // 32 * 32"""


@query("stream_accept_buffer", BUFFER)
def _(t):
    out = fresh_path(t.spark, "accepted")
    mark = fresh_path(t.spark, "checkpoint")
    _feed(t, _steps(t), ["event_id"], lambda s: jobs.stream_accept_buffer(s.filter("score = 0"), "run", "event_id", "event_id", 32, out, mark))
    return t.spark.read.parquet(out).select("run", "step", "key")


@query("accept_buffer", BUFFER)
def _(t):
    df = _steps(t).filter("score = 0").withColumn("key", F.col("event_id"))
    return jobs.accept_buffer(df, "run", "event_id", "key", 32).select("run", "step", "key")


@query("accept_buffer_short", f"""WITH {S}, ok AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM steps WHERE score = 0)
SELECT run, i // 480 AS step, event_id AS key FROM ok WHERE i < n // 480 * 480 + n % 480 // 16 * 16""")
def _(t):
    # the rest of a run is short of a step and is read in whole multiples of 16
    df = _steps(t).filter("score = 0").withColumn("key", F.col("event_id"))
    return jobs.accept_buffer(df, "run", "event_id", "key", 480, k=16).select("run", "step", "key")


@query("stream_steps_sink", """WITH i AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) AS p, count(*) OVER () AS n FROM conversations)
SELECT conv_id, p * 4 // n AS batch, md5(string_agg(text, '|' ORDER BY turn)) AS responses, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS scores FROM i GROUP BY ALL""")
def _(t):
    path = fresh_path(t.spark, "records")
    mark = fresh_path(t.spark, "checkpoint")
    _feed(t, t.conversations, ["conv_id", "turn"], lambda s: jobs.stream_steps_sink(s, ["conv_id"], ["turn"], "text", "turn", path, mark, 1024))
    back = t.spark.read.schema("conv_id long, block long, responses array<string>, scores array<long>, batch long").json(path)
    return back.select("conv_id", "batch", F.md5(F.array_join("responses", "|")).alias("responses"), joined(F.col("scores")).alias("scores"))
