"""Prompt groups of graded samples: acceptance, guidance, advantages, group metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread_rows, stage
from .index import attach_group, same_keys, with_group_index, with_group_totals


def grpo_advantage(df: DataFrame, uid: str, score: str, use_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """Score minus the group mean, over the sample deviation; a lone sample keeps its score."""
    both = attach_group(df, [uid], F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"), F.count(score).alias("_n"))
    mean = F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_m"))
    std = F.when(F.col("_n") == 1, 1.0).otherwise(F.col("_s"))
    adv = F.col(score) - mean
    return both.withColumn("advantage", adv / (std + eps) if use_std else adv).drop("_m", "_s", "_n")


def over_mask(advantage: Column, mask: Column) -> Column:
    """One sequence value on every masked token."""
    return F.transform(mask, lambda m: m * advantage)


def scale_on_policy(advantage: Column, on_policy: Column, weight: float) -> Column:
    return advantage * (1 + (weight - 1) * on_policy.cast("double"))


def group_accuracy(df: DataFrame, uid: str, score: str, resp_len: str, max_len: int) -> DataFrame:
    """Histogram of group accuracies, and how many of those groups hold a truncated response."""
    groups = df.groupBy(uid).agg(F.avg(score).alias("acc"), F.max((F.col(resp_len) >= max_len).cast("int")).alias("_t"))
    return groups.groupBy("acc").agg(F.count("*").alias("groups"), F.sum("_t").alias("truncated_groups"))


def accept_groups(df: DataFrame, uid: str, score: str, resp_len: str, lo: float = 0.001, hi: float = 0.999,
                  reroll_threshold: float | None = 0.0, max_len: int | None = None, k: int = 1,
                  filter_accuracy: bool = True) -> DataFrame:
    """(uid, acc, truncated, accepted, reroll) per group.

    Re-rolled prompts are cut to a multiple of ``k`` in uid order, and to
    nothing below ``k``. When no group is accepted the whole batch is
    re-rolled. Without the accuracy filter nothing is re-rolled.
    """
    return _accept(spread_rows(df, df.count(), uid), uid, score, resp_len, lo, hi, reroll_threshold, max_len, k, filter_accuracy)


def _accept(df: DataFrame, uid: str, score: str, resp_len: str, lo: float, hi: float, reroll_threshold: float | None,
            max_len: int | None, k: int, filter_accuracy: bool = True) -> DataFrame:
    """As :func:`accept_groups`, for rows that lie in partitions by prompt."""
    truncated = F.max(F.coalesce(F.col(resp_len) >= max_len, F.lit(False))) if max_len is not None else F.lit(False)
    groups = df.groupBy(uid).agg(F.avg(score).alias("acc"), truncated.alias("truncated"))
    inside = F.col("acc").between(lo, hi) if filter_accuracy else F.lit(True)
    low = F.col("acc") <= reroll_threshold if filter_accuracy and reroll_threshold is not None else F.lit(False)
    groups = stage(groups.withColumn("accepted", inside & ~F.col("truncated")).withColumn("_low", low), "groups")
    accepted, lows = groups.agg(F.count_if("accepted"), F.count_if("_low")).first()
    if accepted == 0:
        return groups.withColumn("reroll", F.lit(True)).drop("_low")
    keep = lows // k * k
    if keep == lows:
        return groups.withColumnRenamed("_low", "reroll")
    # the last ones in uid order, fewer than k, are left out: all from the least of them on
    cut = groups.filter("_low").select(uid).orderBy(F.col(uid).desc()).limit(lows - keep).agg(F.min(uid)).first()[0]
    return groups.withColumn("reroll", F.col("_low") & F.coalesce(F.col(uid) < F.lit(cut), F.lit(False))).drop("_low")


def accepted_rows(df: DataFrame, groups: DataFrame, uid: str) -> DataFrame:
    """Rows of accepted prompts; ``groups`` holds a prompt once."""
    return _of_prompts(df, groups.filter("accepted"), uid)


def _of_prompts(df: DataFrame, prompts: DataFrame, uid: str) -> DataFrame:
    # an inner join on purpose: a semi join would be moved in front of the partitions that the rows were given
    return df.join(prompts.select(uid), uid).select(*df.columns)


def adaptive_guidance(df: DataFrame, uid: str, variant: str, score: str, resp_len: str, bounds: dict[str, tuple[float, float]],
                      reroll_threshold: float = 0.0, max_len: int | None = None, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with ``on_policy``, per-variant counts).

    Variants are tried in the order of ``bounds``; each later one only for the
    prompts the one before sent to be re-rolled.
    """
    wanted, rows, counts = None, [], []
    # one row per variant
    sizes = {r[0]: r[1] for r in df.filter(F.col(variant).isin(*bounds)).groupBy(variant).agg(F.count("*")).collect()}
    for i, (name, (lo, hi)) in enumerate(bounds.items()):
        own = spread_rows(df.filter(F.col(variant) == name), sizes.get(name, 0), uid)
        part = own if wanted is None else _of_prompts(own, wanted, uid)
        groups = _accept(part, uid, score, resp_len, lo, hi, reroll_threshold, max_len, k)
        # groups hold wanted prompts only
        rows.append(accepted_rows(own, groups, uid).withColumn("on_policy", F.lit(i == 0)))
        counts.append(part.agg(F.countDistinct(uid).alias("prompts"), F.avg(score).alias("accuracy")).withColumn("variant", F.lit(name))
                      .withColumn("accepted_groups", F.lit(groups.filter("accepted").count())))
        wanted = groups.filter("reroll").select(uid)
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, counts)


def balanced_variants(df: DataFrame, variants: list[str], n: int) -> DataFrame:
    """``n`` samples per prompt, equally over the variants; the first one is on-policy."""
    if n % len(variants):
        raise ValueError("samples do not split equally over the variants")
    each = n // len(variants)
    out = df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    name = F.element_at(F.array(*[F.lit(v) for v in variants]), (F.floor(F.col("sample_idx") / each) + 1).cast("int"))
    return out.withColumn("variant", name).withColumn("on_policy", F.col("sample_idx") < each)


def score_by_source(df: DataFrame, source: str, reward: str, fmt: str) -> DataFrame:
    """Mean reward and format score by domain, source, subcategory and overall.

    Every level is keyed by its own name alone, so equal names under different
    parents share a row.
    """
    parts = df.select(reward, fmt, F.posexplode(F.slice(F.split(source, "/"), 1, 3)).alias("_i", "name"))
    levels = F.element_at(F.array(F.lit("domain"), F.lit("source"), F.lit("subcategory")), F.col("_i") + 1)
    means = [F.avg(reward).alias("score"), F.avg(fmt).alias("format_score")]
    return parts.groupBy(levels.alias("level"), "name").agg(*means).unionByName(
        df.agg(*means).select(F.lit("all").alias("level"), F.lit("all").alias("name"), "score", "format_score"))


def pass_at_k(df: DataFrame, uid: str, score: str) -> DataFrame:
    """Share of prompts whose best response scores 1."""
    best = df.groupBy(uid).agg(F.max(score).alias("_b"))
    return best.agg(F.avg((F.col("_b") == 1).cast("double")).alias("pass_at_k"), F.count("*").alias("prompts"))


def token_totals(df: DataFrame, score: str, resp_len: str) -> DataFrame:
    """Samples, tokens, and (in)correct tokens and responses."""
    s, n = F.col(score), F.col(resp_len)
    return df.agg(
        F.count("*").alias("total_train_samples"), F.sum(n).alias("total_train_tokens"),
        F.sum(n * s).alias("total_train_correct_tokens"), F.sum(n * (1 - s)).alias("total_train_incorrect_tokens"),
        F.sum(s).alias("total_train_correct_responses"), F.sum(1 - s).alias("total_train_incorrect_responses"))


def group_responses(df: DataFrame, keys: list[str], order: list[str], response: str, score: str, width: int) -> DataFrame:
    """Responses and scores of each prompt as arrays, at most ``width`` to a row (``block``)."""
    placed = with_group_index(df, keys, [F.col(c) for c in order], "_i").withColumn("block", F.floor(F.col("_i") / width))
    return placed.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("_i", response, score))).alias("_r")).select(
        *keys, "block", F.col(f"_r.{response}").alias("responses"), F.col(f"_r.{score}").alias("scores"))


def pairwise_accuracy(df: DataFrame, uid: str, order: list[str], score: str, acc: str) -> DataFrame:
    """(uid, pair_acc): share of accuracy difference that the scores order rightly, 0.5 without differences.

    Pairs are counted, never listed. In (score, sample order) a pair counts
    when accuracy rises. Accuracies are ranked inside the group; two different
    ranks first part at one bit, so every row joins one node per bit, and a
    node needs the running count and sum of its lower half. Binary accuracy
    has one bit, so each row is read once.
    """
    levels = stage(with_group_index(df.select(uid, acc).distinct(), [uid], [F.col(acc)], "_rank"), "levels")
    bits = levels.groupBy(uid).agg(F.ceil(F.log2(F.max("_rank") + 1)).cast("int").alias("_bits"))
    # one row per accuracy of a group takes its number of bits along, so the rows are joined once
    ranked = same_keys(df.select(uid, *order, score, acc), same_keys(levels, bits, [uid]), [uid, acc])
    nodes = ranked.filter("_bits > 0").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    nodes = nodes.withColumn("_node", F.expr("shiftright(_rank, _b + 1)")).withColumn("_up", F.expr("shiftright(_rank, _b) & 1") == 1)
    low = ~F.col("_up")
    run = with_group_totals(nodes, [uid, "_b", "_node"], [F.col(score), *[F.col(c) for c in order]],
                            {"_n": low.cast("int"), "_s": F.when(low, F.col(acc)).otherwise(0.0)}, kind="double")
    per = run.groupBy(uid, "_b", "_node").agg(
        F.sum(F.when(F.col("_up"), F.col(acc) * F.col("_n") - F.col("_s"))).alias("_good"),
        F.count_if("_up").alias("_n1"), F.count_if(low).alias("_n0"),
        F.sum(F.when(F.col("_up"), F.col(acc))).alias("_s1"), F.sum(F.when(low, F.col(acc))).alias("_s0"))
    sums = per.groupBy(uid).agg(F.sum("_good").alias("_num"), F.sum(F.col("_s1") * F.col("_n0") - F.col("_s0") * F.col("_n1")).alias("_den"))
    share = F.when(F.col("_den") > 0, F.coalesce("_num", F.lit(0.0)) / F.col("_den")).otherwise(0.5)
    return bits.select(uid).join(sums, uid, "left").select(uid, share.alias("pair_acc"))


def ce_preference_loss(df: DataFrame, score_sum: Column, acc: Column, beta: float) -> DataFrame:
    """Mean binary cross-entropy of sigmoid(beta * score sum) against accuracy; logs end at -100."""
    p = 1 / (1 + F.exp(-beta * score_sum))
    log_p, log_q = F.greatest(F.log(p), F.lit(-100.0)), F.greatest(F.log1p(-p), F.lit(-100.0))
    return df.agg(F.avg(-(acc * log_p + (1 - acc) * log_q)).alias("loss"))


def mixin_correct(new: DataFrame, old: DataFrame, uid: str, order: list[str], score: str, carried: list[str]) -> DataFrame:
    """The i-th wrong row of a re-rolled group takes the i-th wrong old row of its prompt while there are any."""
    wrong = F.coalesce(F.col(score) != 1, F.lit(True))
    by = [F.col(c) for c in order]
    bad_new = with_group_index(new.filter(wrong), [uid], by, "_k")
    bad_old = with_group_index(old.filter(F.col(score) == 0).select(uid, *order, *carried), [uid], by, "_k")
    bad_old = bad_old.select(uid, "_k", F.struct(*carried).alias("_o"))
    mixed = bad_new.join(bad_old, [uid, "_k"], "left").withColumn("replaced", F.col("_o").isNotNull())
    mixed = mixed.withColumns({c: F.when(F.col("replaced"), F.col(f"_o.{c}")).otherwise(F.col(c)) for c in carried})
    return new.filter(~wrong).withColumn("replaced", F.lit(False)).unionByName(mixed.drop("_k", "_o"))
