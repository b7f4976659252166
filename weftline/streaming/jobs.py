"""State across batches as streaming queries.

Every job takes a streaming DataFrame and a checkpoint folder, runs what is
available and can be started again on the same folder, where it goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.index import same_keys, with_group_index, with_group_totals
from ..operators.rollout import group_responses
from ..session import stage


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_totals(steps: DataFrame, run: str, score: str, resp_len: str, out: str, checkpoint: str) -> None:
    """Running counters per run; ``out`` holds the whole table after every batch, one folder per batch."""
    s, n = F.col(score), F.col(resp_len)
    totals = steps.groupBy(run).agg(
        F.count("*").alias("total_train_samples"), F.sum(n).alias("total_train_tokens"),
        F.sum(n * s).alias("total_train_correct_tokens"), F.sum(n * (1 - s)).alias("total_train_incorrect_tokens"),
        F.sum(s).alias("total_train_correct_responses"), F.sum(1 - s).alias("total_train_incorrect_responses"))
    _run(totals.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")), checkpoint)


def stream_unique_prompts(steps: DataFrame, prompt: str, out: str, checkpoint: str, event_time: str | None = None, within: str | None = None) -> None:
    """Every prompt once, in the batch that first showed it.

    The seen prompts are state and grow with them; with ``event_time`` and
    ``within`` only that long a past is remembered.
    """
    fresh = steps.dropDuplicates([prompt]) if event_time is None else steps.withWatermark(event_time, within).dropDuplicatesWithinWatermark([prompt])
    _run(fresh.writeStream.outputMode("append").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")), checkpoint)


def kl_factor(kl: Column, target: float, horizon: float, n: Column) -> Column:
    """One step's factor on the coefficient: 1 + clip(kl / target - 1, -0.2, 0.2) * n / horizon."""
    return 1 + F.least(F.greatest(kl / target - 1, F.lit(-0.2)), F.lit(0.2)) * n / horizon


def _slot(path: str, batch: int) -> str:
    return f"{path}/slot={batch % 2}"


def _held(df: DataFrame, path: str, batch: int, schema: str) -> DataFrame:
    """The state that the batch before left; none for the first one.

    State is a table in two slots that take turns: a batch reads the slot of
    the one before it and writes the other, so a batch that is run again finds
    what it found the first time.
    """
    spark = df.sparkSession
    return spark.read.schema(schema).parquet(_slot(path, batch - 1)) if batch else spark.createDataFrame([], schema)


def stream_adaptive_kl(steps: DataFrame, run: str, step: str, kl: str, n: str, out: str, checkpoint: str,
                       init: float, target: float | None, horizon: float = 10000.0) -> None:
    """(run, step, beta, sign, log_beta): the coefficient after every step, sequential per run; fixed without a target.

    Only the sign and the logarithm of one number per run are kept, since a
    long run leaves the range of doubles. Steps of a run must not arrive later
    than their successors; inside a batch they are sorted. A batch is worked on
    by :func:`adaptive_kl`, so the steps of one run spread over tasks.
    """
    typed = steps.select(F.col(run).cast("bigint").alias("run"), F.col(step).cast("bigint").alias("step"), F.col(kl).cast("double").alias("kl"), F.col(n).cast("bigint").alias("n"))
    kept, told = f"{checkpoint}/held", ["run", "step", "beta", "sign", "log_beta"]

    def update(df: DataFrame, batch: int) -> None:
        held = _held(df, kept, batch, "run bigint, held_sign int, held_log double")
        first = F.lit(init)
        known = same_keys(df, held, ["run"], "left").withColumns({
            "held_sign": F.coalesce("held_sign", F.signum(first).cast("int")), "held_log": F.coalesce("held_log", _size(first))})
        if target is None:
            betas = known.select("run", "step", first.cast("double").alias("beta"), F.col("held_sign").alias("sign"), F.col("held_log").alias("log_beta"))
        else:
            betas = _followed(known, "run", "step", "kl", "n", F.col("held_sign"), F.col("held_log"), target, horizon)
        betas.select(*told).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        done = df.sparkSession.read.schema("run bigint, step bigint, beta double, sign int, log_beta double").parquet(f"{out}/batch={batch}")
        last = done.groupBy("run").agg(F.max_by(F.struct("sign", "log_beta"), "step").alias("_l")).select("run", F.col("_l.sign").alias("held_sign"), F.col("_l.log_beta").alias("held_log"))
        same_keys(held, last.select("run"), ["run"], "left_anti").unionByName(last).write.mode("overwrite").parquet(_slot(kept, batch))

    _run(typed.writeStream.outputMode("append").foreachBatch(update), checkpoint)


def _size(x: Column) -> Column:
    """Logarithm of the magnitude; minus infinity for zero."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(F.abs(x)))


def adaptive_kl(steps: DataFrame, run: str, step: str, kl: str, n: str, init: float | Column, target: float, horizon: float = 10000.0) -> DataFrame:
    """Batch form of :func:`stream_adaptive_kl`; ``init`` may be a column that is the same for all steps of a run.

    The update only multiplies, so the coefficient is the start times a running
    product inside the run. A step with a low KL and n beyond 5 x horizon turns
    its sign, so magnitude (as logarithms), signs and zeros are carried apart.
    ``beta`` is a double and leaves its range on long runs; ``sign`` and
    ``log_beta`` (minus infinity for zero) hold its value all the same.
    """
    start = init if isinstance(init, Column) else F.lit(init)
    return _followed(steps, run, step, kl, n, F.signum(start).cast("int"), _size(start), target, horizon)


def _followed(steps: DataFrame, run: str, step: str, kl: str, n: str, sign: Column, log: Column, target: float, horizon: float) -> DataFrame:
    factor = steps.withColumn("_f", kl_factor(F.col(kl), target, horizon, F.col(n)))
    size = F.when(F.col("_f") == 0, 0.0).otherwise(F.log(F.abs("_f")))
    minus, none = (F.col("_f") < 0).cast("int"), (F.col("_f") == 0).cast("int")
    # fixed point: doubles added one after the other would lose the ninth decimal in some 100,000 steps
    run_sum = with_group_totals(factor, [run], [F.col(step)], {"_size": size, "_minus": minus, "_none": none}, kind="decimal(38,18)")
    gone = F.col("_none") + none > 0
    turned = F.when((F.col("_minus") + minus) % 2 == 1, -1).otherwise(1)
    found = run_sum.withColumns({
        "sign": F.when(gone, 0).otherwise(sign * turned).cast("int"),
        "log_beta": F.when(gone, F.lit(float("-inf"))).otherwise(log + (F.col("_size") + size.cast("decimal(38,18)")).cast("double"))})
    return found.withColumn("beta", F.col("sign") * F.exp("log_beta")).drop("_f", "_size", "_minus", "_none")


def stream_accept_buffer(groups: DataFrame, run: str, order: str, key: str, target: int, out: str, checkpoint: str) -> None:
    """(run, step, key): accepted rows in arrival order, exactly ``target`` per step, the rest carried over.

    The state of a run is its step number and fewer than ``target`` carried
    rows. Places inside a run come from group positions, so the rows of one
    run spread over tasks.
    """
    typed = groups.select(F.col(run).cast("bigint").alias("run"), F.col(order).cast("bigint").alias("order"), F.col(key).cast("bigint").alias("key"))
    kept, schema = f"{checkpoint}/held", "run bigint, step bigint, order bigint, key bigint, carried boolean"

    def update(df: DataFrame, batch: int) -> None:
        held = _held(df, kept, batch, schema)
        rows = df.select("run", "order", "key", F.lit(1).alias("new")).unionByName(held.filter("carried").select("run", "order", "key", F.lit(0).alias("new")))
        placed = stage(with_group_index(rows, ["run"], [F.col("new"), F.col("order"), F.col("key")], "_i"), "buffer")
        counts = placed.groupBy("run").agg(F.count("*").alias("_n"))
        steps = held.filter("not carried").select("run", "step")
        known = same_keys(counts, steps, ["run"], "left").select("run", F.coalesce("step", F.lit(0)).alias("_step"), F.floor(F.col("_n") / target).alias("_full"))
        numbered = stage(same_keys(placed, known, ["run"]).withColumn("_rest", F.col("_i") - F.col("_full") * target), "numbered")
        numbered.filter("_rest < 0").select("run", (F.col("_step") + F.floor(F.col("_i") / target)).alias("step"), "key").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        left = numbered.filter("_rest >= 0").select("run", F.lit(None).cast("bigint").alias("step"), F.col("_rest").alias("order"), "key", F.lit(True).alias("carried"))
        after = known.select("run", (F.col("_step") + F.col("_full")).alias("step")).unionByName(same_keys(steps, known.select("run"), ["run"], "left_anti"))
        numbers = after.select("run", "step", F.lit(None).cast("bigint").alias("order"), F.lit(None).cast("bigint").alias("key"), F.lit(False).alias("carried"))
        left.unionByName(numbers).write.mode("overwrite").parquet(_slot(kept, batch))

    _run(typed.writeStream.outputMode("append").foreachBatch(update), checkpoint)


def accept_buffer(groups: DataFrame, run: str, order: str, key: str, target: int, k: int | None = None) -> DataFrame:
    """Batch form of :func:`stream_accept_buffer`: step = floor(place / target).

    Incomplete steps are left out; with ``k`` a last, short step takes what
    :func:`take_from_buffer` reads from a buffer of the rest.
    """
    placed = with_group_index(groups.select(run, order, key), [run], [F.col(order), F.col(key)], "_i")
    held = placed.groupBy(run).agg(F.count("*").alias("_n"))
    full = F.floor(F.col("_n") / target) * target
    used = full if k is None else full + take_from_buffer(F.col("_n") - full, target, k)
    return same_keys(placed, held, [run]).filter(F.col("_i") < used).select(run, F.floor(F.col("_i") / target).alias("step"), key)


def take_from_buffer(held: Column, wanted: int, k: int) -> Column:
    """Rows to read from a buffer: all that are wanted, or the whole multiples of ``k`` it has."""
    return F.when(held >= wanted, F.lit(wanted)).otherwise(held - held % k)


def stream_steps_sink(steps: DataFrame, keys: list[str], order: list[str], response: str, score: str, path: str, checkpoint: str, width: int) -> None:
    """Prompt records of every batch as JSON lines, at most ``width`` responses to a record; a batch that is run again overwrites its own folder."""
    def write(df: DataFrame, batch: int) -> None:
        group_responses(df, keys, order, response, score, width).write.mode("overwrite").json(f"{path}/batch={batch}")
    _run(steps.writeStream.foreachBatch(write), checkpoint)


__all__ = ["stream_totals", "stream_unique_prompts", "stream_adaptive_kl", "adaptive_kl", "stream_accept_buffer", "accept_buffer",
           "take_from_buffer", "stream_steps_sink", "kl_factor"]
