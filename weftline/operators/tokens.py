"""Token-level rewards, returns and diagnostics over one row of arrays per response."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.arrays import let, total
from ..session import stage
from .index import attach_group, attach_single, exact_quantile

DOUBLES = T.ArrayType(T.DoubleType())


def kl_penalty(lp: Column, ref: Column, kind: str) -> Column:
    d = lp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return F.least(F.greatest(F.exp(-d) + d - 1, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(f"unknown kind {kind}")


def eos_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and including the first end id."""
    first = F.least(*[F.when(F.array_position(ids, e) > 0, F.array_position(ids, e)).otherwise(F.size(ids)) for e in eos], F.size(ids))
    first = first.cast("int")
    return F.concat(F.array_repeat(F.lit(1), first), F.array_repeat(F.lit(0), F.size(ids) - first))


def position_ids(mask: Column) -> Column:
    """Positions among the masked tokens; 0 before the first one.

    Masks are zeros then ones then zeros, so the running count is the distance
    from the first one, capped by their number.
    """
    bound = F.struct(F.array_position(mask, 1).alias("lead"), total(mask).alias("ones"))
    return let(bound, lambda b: F.transform(mask, lambda _, i: F.greatest(F.least(i - b["lead"] + 1, b["ones"] - 1), F.lit(0)).cast("int")))


def expand_to_token(score: Column, mask: Column) -> Column:
    """The sequence score on the last valid token, zeros elsewhere."""
    ones, value = total(mask), score.cast("double")
    placed = F.concat(F.array_repeat(F.lit(0.0), ones - 1), F.array(value), F.array_repeat(F.lit(0.0), F.size(mask) - ones))
    return F.when(ones > 0, placed).otherwise(F.array_repeat(F.lit(0.0), F.size(mask)))


def remove_pad(ids: Column, mask: Column) -> Column:
    """The last ids, as many as the mask counts (left padding)."""
    n = F.aggregate(mask, F.lit(0), lambda s, m: s + m)
    return F.when(n > 0, F.slice(ids, F.size(ids) - n + 1, n)).otherwise(F.slice(ids, 1, 0))


def discounted(values: Column, factor: float, carry: Column | None = None) -> Column:
    """Backward sums out[t] = x[t] + factor * carry[t+1] * out[t+1].

    A fold that builds an array is quadratic in Spark expressions, so the
    linear recurrence runs per Arrow batch.
    """
    @F.pandas_udf(DOUBLES)
    def back(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else list(accumulate(x[::-1], lambda c, v: v + factor * c))[::-1])

    @F.pandas_udf(DOUBLES)
    def back_carry(xs: pd.Series, ms: pd.Series) -> pd.Series:
        def one(x, m):
            pairs = zip(x[::-1][1:], m[::-1])
            return list(accumulate(pairs, lambda c, vm: vm[0] + factor * c * vm[1], initial=x[-1]))[::-1] if len(x) else []
        return pd.Series([one(x, m) for x, m in zip(xs, ms)])

    return back(values) if carry is None else back_carry(values, carry)


def explode_tokens(df: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """One row per token with its index ``t``."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(*keys, F.posexplode(zipped).alias("t", "_z")).select(*keys, "t", *[F.col(f"_z.{n}").alias(n) for n in arrays])


def masked_stats(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: count, sum, mean and sample variance of masked tokens; under two tokens is an error."""
    tok = df.select(F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("_z")).filter("_z.m <> 0")
    s = tok.agg(F.count("_z.v").alias("n"), F.sum("_z.v").alias("total"), F.avg("_z.v").alias("mean"), F.var_samp("_z.v").alias("var"))
    return s.withColumn("n", F.when(F.col("n") < 2, F.raise_error(F.lit("the mask leaves fewer than two tokens"))).otherwise(F.col("n")))


def row_masked_mean(values: Column, mask: Column) -> Column:
    kept = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda s, x: s + x)
    return kept / total(mask)


def masked_whiten(df: DataFrame, values: str, mask: str, out: str, keep_mean: bool = False, remask: bool = False) -> DataFrame:
    """Values minus the masked mean, over sqrt(variance + 1e-8)."""
    both = attach_single(df, masked_stats(df, values, mask), "n", "mean", "var")
    scale = 1 / F.sqrt(F.col("var") + 1e-8)
    shift = F.col("mean") if keep_mean else F.lit(0.0)
    # reading n keeps its guard in the plan
    guard = F.when(F.col("n") > 1, F.col("mean"))
    white = F.transform(values, lambda v: (v - guard) * scale + shift)
    if remask:
        white = F.zip_with(white, mask, lambda v, m: v * m)
    return both.withColumn(out, white).drop("n", "mean", "var")


def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Advantages and returns; values beyond the end are 0, padding takes part, advantages are whitened."""
    v = F.col(values)
    nxt = F.concat(F.slice(v, F.lit(2), F.size(v)), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, nxt, lambda r, n: r + gamma * n), values, lambda d, x: d - x)
    raw = df.withColumn("_adv", discounted(delta, gamma * lam)).withColumn("returns", F.zip_with("_adv", values, lambda a, x: a + x))
    return masked_whiten(stage(raw, "returns"), "_adv", mask, "advantages").drop("_adv")


def reinforce_pp(df: DataFrame, rewards: str, mask: str, gamma: float) -> DataFrame:
    """Discounted returns reset after the end; advantages are whitened and masked."""
    raw = df.withColumn("returns", discounted(F.col(rewards), gamma, F.col(mask)))
    return masked_whiten(stage(raw, "returns"), "returns", mask, "advantages", remask=True)


def remax(df: DataFrame, rewards: str, mask: str, baseline: str) -> DataFrame:
    """Masked reward still to come, less the greedy response's reward."""
    kept = F.zip_with(rewards, mask, lambda r, m: r * m)
    out = df.withColumn("returns", discounted(kept, 1.0))
    return out.withColumn("advantages", F.zip_with("returns", mask, lambda r, m: r - F.col(baseline) * m))


def rloo(df: DataFrame, uid: str, mask: str, token_scores: str, final_score: str, token_gamma: float, final_gamma: float) -> DataFrame:
    """Leave-one-out returns of a per-token source and a final-token source, summed and whitened.

    A source's value becomes r * n/(n-1) minus the sum of the group's row
    means over n-1; a lone sample keeps its reward.
    """
    base = df.withColumn("_rm", row_masked_mean(F.col(token_scores), F.col(mask)))
    both = attach_group(base, [uid], F.count("*").alias("_n"), F.sum("_rm").alias("_ts"), F.sum(final_score).alias("_fs"))
    n = F.col("_n")

    def centred(r, total):
        return F.when(n > 1, r * n / (n - 1) - total / (n - 1)).otherwise(r)
    tok = F.zip_with(token_scores, mask, lambda r, m: F.when(m != 0, centred(r, F.col("_ts"))).otherwise(0.0))
    fin = expand_to_token(centred(F.col(final_score), F.col("_fs")), F.col(mask))
    parts = both.withColumn("_a", discounted(tok, token_gamma)).withColumn("_b", discounted(fin, final_gamma))
    raw = parts.withColumn("returns", F.zip_with("_a", "_b", lambda a, b: a + b)).drop("_rm", "_n", "_ts", "_fs", "_a", "_b")
    # read twice, for the statistics and for the rows
    return masked_whiten(stage(raw, "returns"), "returns", mask, "advantages")


def kl_shaped_reward(df: DataFrame, scores: str, lp: str, ref: str | None, mask: str, beta: float, kind: str = "kl") -> DataFrame:
    """Token scores less beta * KL on valid tokens; ``seq_kl`` is the sequence's mean KL."""
    if ref is None:
        return df.withColumn("shaped", F.col(scores)).withColumn("seq_kl", F.lit(0.0))
    kl = F.zip_with(F.zip_with(lp, ref, lambda a, b: kl_penalty(a, b, kind)), mask, lambda k, m: k * m)
    out = df.withColumn("_kl", kl)
    return out.withColumn("shaped", F.zip_with(scores, "_kl", lambda s, k: s - beta * k)).withColumn(
        "seq_kl", row_masked_mean(F.col("_kl"), F.col(mask))).drop("_kl")


def policy_diagnostics(df: DataFrame, old_lp: str, lp: str, advantages: str, mask: str, on_policy: str, clip: float = 0.2,
                       strategy: str = "constant", value: float = 0.1, token_mean: bool = True, use_clip: bool = True) -> DataFrame:
    """Policy loss, KL and clip fraction, overall and for on- and off-policy rows.

    Off-policy ratios are shaped: r/(r+value), r/(r+quantile of r) or r**value;
    only on-policy rows are clipped; clip fractions compare with a fixed 0.2.
    """
    tok = explode_tokens(df.withColumn("_on", F.col(on_policy).cast("boolean")).withColumn("_len", F.size(mask)), ["_on", "_len"],
                         o=old_lp, l=lp, a=advantages, m=mask)
    tok = tok.withColumn("_kl", F.col("o") - F.col("l")).withColumn("_r", F.exp(F.col("l") - F.col("o")))
    r = F.col("_r")
    if strategy == "constant":
        shaped = r / (r + value)
    elif strategy == "percentile":
        q = exact_quantile(tok.filter("not _on"), "_r", value)
        shaped = r / (r + max(q, 1e-4)) if q is not None else r
    elif strategy == "power":
        shaped = F.pow(r, F.lit(value))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    tok = tok.withColumn("_r", F.when(F.col("_on"), r).otherwise(shaped))

    def clipped(c):
        return F.least(F.greatest(r, F.lit(1.0 - c)), F.lit(1.0 + c))
    plain = -F.col("a") * r
    loss = F.greatest(plain, -F.col("a") * F.when(F.col("_on"), clipped(clip)).otherwise(r)) if use_clip else plain
    tok = tok.withColumn("_loss", loss).withColumn("_cut", (-F.col("a") * clipped(0.2) > F.col("_loss")).cast("double"))

    def mean(c, rows, name):
        kept = F.when(rows, F.col("m"))
        return F.coalesce(F.sum(F.col(c) * kept) / F.sum(kept), F.lit(0.0)).alias(name)
    every, on, off = F.lit(True), F.col("_on"), ~F.col("_on")
    overall = mean("_loss", every, "pg_loss") if token_mean else (F.sum(F.col("_loss") * F.col("m")) / F.max("_len")).alias("pg_loss")
    return tok.agg(overall, mean("_cut", every, "pg_clipfrac"), mean("_kl", every, "ppo_kl"),
                   mean("_loss", on, "on_pg_loss"), mean("_loss", off, "off_pg_loss"), mean("_kl", on, "on_ppo_kl"),
                   mean("_kl", off, "off_ppo_kl"), mean("_cut", on, "on_pg_clipfrac"), mean("_cut", off, "off_pg_clipfrac"))


def value_diagnostics(df: DataFrame, predicted: str, returns: str, values: str, mask: str, clip: float) -> DataFrame:
    """Half the masked mean of the larger squared error, plain or clipped around the old value."""
    tok = explode_tokens(df, [], p=predicted, r=returns, v=values, m=mask)
    p, r, v = F.col("p"), F.col("r"), F.col("v")
    bounded = F.least(F.greatest(p, v - clip), v + clip)
    one, two = (p - r) * (p - r), (bounded - r) * (bounded - r)
    n = F.sum("m")
    return tok.agg((0.5 * F.sum(F.greatest(one, two) * F.col("m")) / n).alias("vf_loss"),
                   (F.sum((two > one).cast("double") * F.col("m")) / n).alias("vf_clipfrac"))


def data_metrics(df: DataFrame, scores: str, rewards: str, advantages: str, returns: str, values: str | None, mask: str,
                 prompt_len: str, verify: str, fmt: str, max_prompt: int) -> DataFrame:
    """(metric, value): sequence, token and length statistics of a batch."""
    def added(c):
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    def spread(col, name):
        return [F.avg(col).alias(f"{name}/mean"), F.max(col).alias(f"{name}/max"), F.min(col).alias(f"{name}/min")]
    seq = df.select(added(scores).alias("s"), added(rewards).alias("r"), F.aggregate(mask, F.lit(0), lambda s, m: s + m).cast("double").alias("n"),
                    F.size(mask).alias("cap"), F.col(prompt_len).cast("double").alias("p"), F.col(verify).alias("vs"), F.col(fmt).alias("fs"))
    rows = seq.agg(
        *spread("s", "critic/score"), *spread("r", "critic/rewards"), *spread("n", "response_length"),
        F.avg((F.col("n") == F.col("cap")).cast("double")).alias("response_length/clip_ratio"),
        *spread("p", "prompt_length"), F.avg((F.col("p") == max_prompt).cast("double")).alias("prompt_length/clip_ratio"),
        F.avg("vs").alias("train/filter_accuracy"), F.avg("fs").alias("train/format_accuracy"))
    names = dict(a=advantages, r=returns, m=mask, **({"v": values} if values else {}))
    tok = explode_tokens(df, [], **names).filter("m <> 0")
    parts = [*spread("a", "critic/advantages"), *spread("r", "critic/returns")]
    if values:
        parts += [*spread("v", "critic/values"),
                  (1.0 - F.var_samp(F.col("r") - F.col("v")) / (F.var_samp("r") + 1e-5)).alias("critic/vf_explained_var")]
    toks = tok.agg(*parts)
    return rows.unpivot([], list(rows.columns), "metric", "value").unionByName(toks.unpivot([], list(toks.columns), "metric", "value"))


SECTIONS = ("gen", "ref", "values", "adv", "update_critic", "update_actor")


def timing_metrics(lengths: DataFrame, prompt_len: str, resp_len: str, timings: DataFrame) -> DataFrame:
    """(metric, value): seconds per stage and milliseconds per token; generation counts response tokens only."""
    sums = lengths.agg(F.sum(prompt_len).alias("p"), F.sum(resp_len).alias("r"))
    both = attach_single(timings, sums, "p", "r")
    tokens = F.when(F.col("stage") == "gen", F.col("r")).otherwise(F.col("p") + F.col("r"))
    return both.select(F.concat(F.lit("timing_s/"), "stage").alias("metric"), F.col("seconds").alias("value")).unionByName(
        both.filter(F.col("stage").isin(*SECTIONS)).select(
            F.concat(F.lit("timing_per_token_ms/"), "stage").alias("metric"), (F.col("seconds") * 1000 / tokens).alias("value")))


def cloze_accuracy(df: DataFrame, target: str, predicted: str, mask: str) -> DataFrame:
    """Share of rows whose every unmasked target is predicted."""
    right = F.forall(F.arrays_zip(F.col(target).alias("a"), F.col(predicted).alias("b"), F.col(mask).alias("m")),
                     lambda z: (z["m"] == 0) | (z["a"] == z["b"]))
    return df.agg(F.count("*").alias("rows"), F.count_if(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy"))
